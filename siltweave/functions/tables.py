"""Table functions for lateral joins: links, table cells, sitemap locations and lines of a body."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TableCells:
    def eval(self, html: str):
        from siltweave.functions.dom import parse
        from siltweave.operators.markdown import Renderer, Rules

        for t, node in enumerate(parse(html).select("table")):
            grid, heads = Renderer(Rules()).grid(node)
            for y, row in enumerate(grid):
                for x, text in enumerate(row):
                    yield t, y, x, y < heads, text


#: Table functions that are SQL over built-in generators: name, parameter, columns, body.
GENERATORS = (
    ("extract_links", "html", "at int, href string", """select pos, col from posexplode(regexp_extract_all(html, 'href="([^"#]+)"', 1))"""),
    ("text_lines", "text", "line_no int, line string", "select pos + 1, col from posexplode(split(text, '\\n'))"),
    ("sitemap_urls", "xml", "url string", "select trim(col) from explode(regexp_extract_all(xml, '(?is)<loc>\\\\s*(?:<!.CDATA.)?\\\\s*(https?://[^<\\]]*)', 1))"),
)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL; only the one that needs a DOM runs in Python."""
    for name, parameter, columns, body in GENERATORS:
        spark.sql(f"create or replace temporary function {name}({parameter} string) returns table ({columns}) return {body}")
    spark.udtf.register("table_cells", udtf(TableCells, returnType="tbl int, row int, col int, is_header boolean, text string"))
