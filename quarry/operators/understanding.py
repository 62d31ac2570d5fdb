"""Understanding of questions: intent, language, terms, clause references, conversation context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.cleaning import ascii_words, script_counts

# Intent rules in order, stop words and reference patterns.
INTENT_RULES = [
    ("out_of_scope", r"(?iU)^\s*(hi|hello|hey|namaste|thanks|thank you|how are you|who are you|good (morning|evening)|tell me a joke|what'?s up)\W*$"),
    ("compare", r"(?iU)\b(compare|comparison|vs\.?|versus|difference|differences|differ)\b|तुलना|अंतर|ಹೋಲಿಕೆ|ವ್ಯತ್ಯಾಸ"),
    ("clause_lookup", r"(?iU)\b(clause|cl\.|section|annex|annexure)\s*[A-Z]?-?\d+(\.\d+)*|खंड\s*\d|ಖಂಡ\s*\d"),
    ("applicability", r"(?iU)\b(my product|my products|my business|my company|my factory|i make|i manufacture|we make|we manufacture|we produce|i produce|i sell|we sell|apply to my|for my)\b|मेरे उत्पाद|मेरा उत्पाद|ನನ್ನ ಉತ್ಪನ್ನ"),
    ("summarize", r"(?iU)\b(explain|summari[sz]e|summary|simple language|simple terms|in simple|overview of|plain language|eli5)\b|सरल|समझा|सारांश|ವಿವರಿಸಿ|ಸರಳ|ಸಾರಾಂಶ"),
    ("requirements", r"(?iU)\b(requirements?|tests?|testing|test methods?|checklist|what must|must meet|limits?|specifications? for|criteria)\b|परीक्षण|आवश्यकता|ಪರೀಕ್ಷೆ|ಅವಶ್ಯಕತೆ|ಅಗತ್ಯ"),
    ("discover", r"(?iU)\b(which (bis |indian )?standards?|what (bis |indian )?standards?|applicable|apply to|applies to|relevant standards?|standards? (for|on|covering)|is there a standard)\b|लागू|कौन.?से.{0,10}मानक|ಅನ್ವಯ|ಯಾವ.{0,20}ಮಾನದಂಡ"),
    ("define", r"(?iU)^\s*(what is|what's|what are|meaning of|define|definition of|what does .* mean)\b|क्या है|का अर्थ|ಎಂದರೇನು|ಅರ್ಥ"),
]
NOT_A_DEFINITION = r"(?iU)\b(requirements?|tests?|testing|process|procedure|fee|steps)\b"
ANAPHORA = r"(?iU)\b(this|that|these|those|it|its|they|them|the standard|the same|above|both)\b|यह|इस|इसके|ये|इन|ಈ|ಅದರ|ಇದು|ಇವು"
CLAUSE_REF = (
    r"(?i)\b(?:clause|cl\.|section|sec\.)\s*([A-H]-\d+(?:\.\d+)*|\d+(?:\.\d+)*)|\b(Table\s+\d+)|"
    r"\b(Annex(?:ure)?\s*-?\s*[A-Z]|Annex(?:ure)?\s*-?\s*[IVX]+)"
)
STOPWORDS = (
    "a an the of for to in on at by with from and or is are was were be been being what which who whom whose how why when where "
    "do does did can could should would will shall may might must i me my we our you your it its this that these those there "
    "about as into than then so such any all some no not only also please tell give list show explain simple language "
    "bis standard standards indian apply applies applicable relevant"
).split()
FOLLOW_UP_INTENTS = ("requirements", "summarize", "compare", "clause_lookup")


def intent(question: Column, ascii: bool = False) -> Column:
    """The first rule that matches; a definition that asks for requirements or a process is no definition. With ascii,
    other letters than ASCII's end a word."""
    has = lambda p: question.rlike(ascii_words(p) if ascii else p)
    out = F.lit("ask")
    for name, pattern in reversed(INTENT_RULES):
        hit = has(pattern)
        out = F.when(hit & ~has(NOT_A_DEFINITION) if name == "define" else hit, name).otherwise(out)
    return out


def language(question: Column) -> Column:
    """en, hi or kn by the script of most letters; en where there is none or scripts tie with Latin."""
    n = script_counts(question)
    return F.when((n["devanagari"] > n["latin"]) & (n["devanagari"] >= n["kannada"]), "hi").when(
        (n["kannada"] > n["latin"]) & (n["kannada"] > n["devanagari"]), "kn"
    ).otherwise("en")


def content_terms(question: Column) -> Column:
    """Words and numbers of two characters or more that aren't stop words."""
    found = F.regexp_extract_all(question, F.lit(r"([A-Za-z][A-Za-z0-9\-]*|\d+(?:\.\d+)?)"), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, F.lower(w)))


def clause_refs(question: Column) -> Column:
    groups = F.arrays_zip(*[F.regexp_extract_all(question, F.lit(CLAUSE_REF), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])
    return F.transform(groups, lambda g: F.when(g["g1"] != "", g["g1"]).when(g["g2"] != "", g["g2"]).otherwise(g["g3"]))


def follow_ups(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ascii: bool = False
) -> DataFrame:
    """User turns with recent (the last two user questions before, oldest first), intent and follow_up. With ascii, other
    letters than ASCII's end a word."""
    asked = turns.where(F.col(role) == "user")
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(-2, -1)
    out = asked.withColumn("recent", F.collect_list(text).over(before)).withColumn("intent", intent(F.col(text), ascii))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    like = F.col(text).rlike(ascii_words(ANAPHORA) if ascii else ANAPHORA) | (words <= 6) | F.col("intent").isin(*FOLLOW_UP_INTENTS)
    return out.withColumn("follow_up", (F.size("recent") > 0) & like)
