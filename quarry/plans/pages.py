"""Pages by their elements: sections of the given pages, and official lists written as tables with spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import structure as sr
from quarry.plans.core import query
from quarry.sources import elements as el
from quarry.tables import written


@query()
def page_sections(t):
    return el.page_sections(t("pages")).withColumnRenamed("page", "page_id")


def list_pages(part: DataFrame) -> DataFrame:
    """(page_id, html): a page a brand with a list of its parts. A category spans the row above every part of a size that
    seven divides; an order's cell reaches into the next part's row, past a category row where one lies between."""
    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    cell = lambda *texts: F.concat(F.lit("<td>"), *texts, F.lit("</td>"))
    number, odd = F.concat(F.lit("IS "), (F.col("p_partkey") + 100).cast("string")), F.col("nth") % 2 == 1
    row = F.concat(
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("<tr><th colspan=4>"), "p_type", F.lit("</th></tr>"))).otherwise(""),
        F.lit("<tr>"), cell(F.col("nth").cast("string")), cell(number), cell(F.lit("<b>"), "p_name", F.lit("</b><br>")),
        F.when(odd, F.concat(F.lit('<td rowspan="2">Order of '), "p_partkey", F.lit("</td>"))).otherwise(""), F.lit("</tr>"),
    )
    rows = part.withColumn("nth", nth).select("p_brand", "nth", row.alias("row")).groupBy("p_brand")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda r: r["row"]), "")
    head = "<!DOCTYPE html><body><h1>List</h1><table><tr><th>Sl</th><th>IS No.</th><th>Product</th><th>Notification</th></tr>"
    return rows.agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html")).withColumnRenamed("p_brand", "page_id")


_LISTED = """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part),
listed AS (SELECT *, last_value(CASE WHEN p_size % 7 = 0 THEN p_type END IGNORE NULLS) OVER w AS category, CASE WHEN nth % 2 = 1 THEN p_partkey ELSE lag(p_partkey) OVER w END AS since
  FROM placed WINDOW w AS (PARTITION BY p_brand ORDER BY nth))"""


@query(f"""{_LISTED} SELECT p_brand AS page_id, category, 'IS ' || (p_partkey + 100) AS number, p_name AS product, 'Order of ' || since AS order_text FROM listed""")
def official_lists(t):
    runs = written(el.text_runs(list_pages(t("part"))), "list-runs")
    rows = el.list_rows(el.grids(el.table_cells(runs))).where("not is_header")
    return rows.select(F.col("page").alias("page_id"), "category", F.explode("numbers").alias("number"), "product", F.col("order").alias("order_text"))


@query(f"""{_LISTED} SELECT p_brand AS page_id, category, 'IS ' || (p_partkey + 100) AS number, p_name AS product, count(*) AS n FROM listed GROUP BY ALL""")
def listed_products(t):
    runs = written(el.text_runs(list_pages(t("part"))), "list-runs")
    rows = el.list_rows(el.grids(el.table_cells(runs)))
    text = F.when(F.col("is_header"), F.col("category")).otherwise(F.col("product"))
    cells = rows.select("page", "row", "is_header", text.alias("text"), F.get("numbers", 0).alias("number"))
    return sr.catalogue_groups(cells, "page").groupBy(F.col("page").alias("page_id"), "category", "number", "product").agg(F.count("*").alias("n"))
