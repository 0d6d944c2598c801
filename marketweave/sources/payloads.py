"""Raw payloads as typed rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

#: Fixed value: annual, quarterly and current reports.
FORMS = ("10-K", "10-Q", "8-K")


def price_bars(payload: DataFrame) -> DataFrame:
    """Bars from stock_code, tz and arrays timestamp (seconds), open, high, low, close, adjclose, volume: without missing closes, the first of each local day."""
    fields = ["timestamp", "open", "high", "low", "close", "adjclose", "volume"]
    each = payload.select("stock_code", "tz", F.posexplode(F.arrays_zip(*fields)).alias("pos", "b")).where("b.close IS NOT NULL")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.timestamp"), F.col("tz")))
    one = each.withColumn("trade_date", day).groupBy("stock_code", "trade_date").agg(F.min_by("b", "pos").alias("b"))
    return one.select("stock_code", "trade_date", *[F.col(f"b.{f}").alias("adj_close" if f == "adjclose" else f) for f in fields[1:]])


def filings(payload: DataFrame, most: int = 20) -> DataFrame:
    """Documents from stock_code and arrays form, filingDate, accessionNumber, primaryDocument: reports only, the first most of a stock."""
    each = payload.select("stock_code", F.posexplode(F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument")).alias("pos", "f")).where(F.col("f.form").isin(*FORMS))
    n = F.row_number().over(Window.partitionBy("stock_code").orderBy("pos"))
    folder = F.replace("f.accessionNumber", F.lit("-"), F.lit(""))
    return each.withColumn("n", n).where(F.col("n") <= most).select(
        "stock_code", F.col("n").alias("place"), F.lit("sec_edgar").alias("source"), F.lit("filing").alias("doc_type"), F.format_string("%s filing %s", "stock_code", "f.form").alias("title"),
        F.format_string("Form %s filed on %s", "f.form", "f.filingDate").alias("body"), F.format_string("https://www.sec.gov/Archives/edgar/data/%s/%s/%s", "stock_code", folder, "f.primaryDocument").alias("url"),
    )


def alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """Aliases from CSV with a header: type manual and weight 1 unless given (a bad number is not), active unless said otherwise; rows without ticker or alias are left out."""
    raw = spark.read.csv(path, header=True)
    return shaped_aliases(raw)


def shaped_aliases(raw: DataFrame) -> DataFrame:
    """See alias_csv; raw has text columns."""
    col = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    active = (col("is_active") == "") | F.lower(col("is_active")).isin("1", "true", "y", "yes")
    out = raw.select(F.upper(col("ticker")).alias("ticker"), col("alias").alias("alias"), F.when(col("alias_type") == "", "manual").otherwise(col("alias_type")).alias("alias_type"), F.coalesce(col("weight").try_cast("double"), F.lit(1.0)).alias("weight"), active.alias("is_active"))
    return out.where("ticker <> '' AND alias <> ''")


#: Where articles stand in pages, in the order of trial; elements that hold nothing or nothing to read.
CONTAINERS = ("article", "main", "#articletxt", "#dic_area", ".article-body", ".news_cnt_detail_wrap")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr"))
UNREAD = frozenset(("script", "style", "template"))


class _Article(HTMLParser):
    """Texts of the paragraphs inside the first element that each selector (tag, #id or .class) picks, and of the whole page, in one pass over its tags."""

    def __init__(self, selectors: Sequence[str]):
        super().__init__()
        self.selectors, self.path, self.text = selectors, [], []
        #: Of each selector that has met its element: the paragraphs inside.
        self.parts: dict[str, list[list[str]]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        """An open element is its tag, the selectors that it is the first of, and, of a paragraph, the lists that its text goes to."""
        named = dict(attrs)
        picks = {tag, f"#{named.get('id')}", *(f".{c}" for c in (named.get("class") or "").split())}
        first = [s for s in self.selectors if s in picks and s not in self.parts]
        inside = [s for _, ss, _ in self.path for s in ss]
        heard: list[list[str]] = []
        if tag == "p":
            for s in inside:
                heard.append([])
                self.parts[s].append(heard[-1])
        for s in first:
            self.parts[s] = []
        if tag not in VOID:
            self.path.append((tag, first, heard))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.path.pop()

    def handle_endtag(self, tag: str) -> None:
        """Closes the innermost open element of this tag, and what is open inside it."""
        at = next((k for k in reversed(range(len(self.path))) if self.path[k][0] == tag), None)
        if at is not None:
            del self.path[at:]

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not any(tag in UNREAD for tag, _, _ in self.path):
            self.text.append(data)
            for _, _, heard in self.path:
                for h in heard:
                    h.append(data)


def article_text(html: str | None, least: int = 12, most: int = 10, longest: int = 3000, containers: Sequence[str] = CONTAINERS) -> str:
    """The first paragraphs of least characters inside the first container that has any, else the beginning of the page's text."""
    parser = _Article(containers)
    parser.feed(html or "")
    parser.close()
    joined = lambda parts: " ".join(" ".join(parts).split())
    for c in containers:
        found = [p for p in map(joined, parser.parts.get(c, [])) if len(p) >= least]
        if found:
            return "\n".join(found[:most])
    return joined(parser.text)[:longest]


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text of pages (page_id, url, html)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "text": [article_text(h) for h in p["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")


def json_strings(value: Column) -> Column:
    """An array of strings from JSON; bad JSON gives an empty one."""
    return F.coalesce(F.from_json(value, T.ArrayType(T.StringType())), F.expr("array()").cast("array<string>"))


def listings(payload: DataFrame, stocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ticker, name, market from rows (pos, item as JSON, an object or an array of objects) with alternative key names; the last row of a ticker wins; stocks (code, name, market) where there are none at all.

    keys are columns of payload that tell stocks apart where several share a ticker: the last row of each counts.
    """
    text = F.trim("item")
    wrapped = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    each = payload.select(*keys, "pos", F.posexplode(F.from_json(wrapped, "array<map<string,string>>")).alias("k", "m"))
    pick = lambda *names: F.coalesce(*[F.when(F.trim(F.element_at("m", n)) != "", F.trim(F.element_at("m", n))) for n in names])
    rows = each.select(*keys, F.struct("pos", "k").alias("at"), pick("srtnCd", "isuSrtCd", "ticker").alias("ticker"), pick("itmsNm", "isuAbbrv", "name").alias("name"), pick("mrktCtg", "marketName", "market").alias("market")).where("ticker IS NOT NULL AND name IS NOT NULL")
    rows = rows.withColumn("ticker", F.upper(F.regexp_replace("ticker", "^A(?=\\d{6}$)", "")))
    found = rows.groupBy(*keys, "ticker").agg(F.max_by(F.struct("name", "market"), "at").alias("r")).select("ticker", "r.*")
    return stocks.select(F.col("code").alias("ticker"), "name", "market") if found.isEmpty() else found


def company_codes(xml: DataFrame, stocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """stock_code, corp_code, corp_name from rows of XML (column xml: a root element with an element list for each company) with 8-digit company and 6-digit stock codes of active stocks.

    A real reader: entities, CDATA and attributes are understood. Rows that are no XML, or null, give nothing. Of several entries of a stock the last of a row counts.
    keys are columns of xml and stocks that tell stocks apart where several share a code.
    """
    entries = F.from_xml(F.col("xml"), "list array<struct<corp_code:string,corp_name:string,stock_code:string>>")
    each = xml.select(*keys, entries.alias("x")).select(*keys, F.posexplode("x.list").alias("pos", "e"))
    rows = each.select(*keys, "pos", *[t.compact(F.col(f"e.{c}")).alias(c) for c in ("stock_code", "corp_code", "corp_name")])
    good = rows.where(F.col("stock_code").rlike(r"^\d{6}$") & F.col("corp_code").rlike(r"^\d{8}$"))
    last = good.groupBy(*keys, "stock_code").agg(F.max_by(F.struct("corp_code", "corp_name"), "pos").alias("r")).select(*keys, "stock_code", "r.*")
    return last.join(stocks.where("is_active").select(*keys, F.col("code").alias("stock_code")), [*keys, "stock_code"], "left_semi").select("stock_code", "corp_code", "corp_name")


def news_items(payload: DataFrame, most: int = 20) -> DataFrame:
    """Documents from stock_code and items (array of title, description, originallink, link): without tags, those with title and address only, the first most."""
    bare = lambda c: t.compact(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>|&quot;|&amp;", ""))
    each = payload.select("stock_code", F.posexplode("items").alias("pos", "i"))
    link = F.when(F.trim("i.originallink") != "", F.trim("i.originallink")).otherwise(F.trim("i.link"))
    rows = each.select("stock_code", "pos", bare(F.col("i.title")).alias("title"), bare(F.col("i.description")).alias("body"), link.alias("url")).where("title <> '' AND coalesce(url, '') <> ''")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("stock_code").orderBy("pos"))).where(F.col("n") <= most).drop("n")


def disclosures(rows: DataFrame, words: list[str], most: int = 20) -> DataFrame:
    """Documents from stock_code, corp_name, report_nm, rcept_no, rcept_dt: reports with a keyword (all if there are none), newest first, the first most of a stock."""
    kept = rows.where(F.exists(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains("report_nm", w))) if words else rows
    n = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.col("rcept_dt").desc(), F.col("rcept_no").desc()))
    return kept.withColumn("n", n).where(F.col("n") <= most).select(
        "stock_code", F.format_string("[%s] %s", "corp_name", "report_nm").alias("title"), F.concat_ws("\n", F.concat(F.lit("Report: "), "report_nm"), F.concat(F.lit("Received: "), "rcept_dt")).alias("body"),
        F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), "rcept_no").alias("url"), "rcept_dt",
    )


def quote_snapshot(payload: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """stock_code and a double per field from JSON (column quote): the first path that leads to a number, raw values of wrapped ones."""
    value = lambda path: F.coalesce(F.get_json_object("quote", f"$.{path}.raw"), F.get_json_object("quote", f"$.{path}")).try_cast("double")
    return payload.select("stock_code", *[F.coalesce(*[value(p) for p in paths]).alias(name) for name, paths in fields.items()])
