"""Text, date, number and display functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track visitors, words and endings that say nothing about a title's topic, sections of summaries.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "smid", "from"]
TITLE_STOP_WORDS = ["속보", "단독", "종합", "영상", "인터뷰", "기자", "뉴스", "리포트", "증권", "강조했다", "밝혔다", "전했다"]
PARTICLES, ENDINGS = "이가은는을를의에도만로와과", "에게|에서|으로|라고|이고|이며|하다|했다|한다|됐다|되었다"
FACT_TOKEN = r"\b20\d{2}[./-]\d{1,2}[./-]\d{1,2}\b|\b\d+(?:[.,]\d+)?%|\b\d+(?:[.,]\d+)?\b|\b[A-Z]{2,6}\b"
ADVICE = r"(?iU)\b강력\s*매수\b|\b매수\b|\b매도\b|\b비중\s*확대\b|\b지금\s*사\b|\b팔아야\b|\bstrong\s*buy\b|\bbuy\s*now\b|\bsell\s*now\b"
ADVICE_REPLACEMENT = "투자 판단은 추가 확인이 필요합니다."
NUMERIC_CONTEXT, NUMERIC_WORDS = r"\d(?:%|\s*[원억조만])|[eE][pP][sS]", ["실적", "매출", "영업이익", "목표가", "가이던스", "전망"]
SECTIONS = ["conclusion", "evidence", "risk", "checkpoint", "final"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row even where use refers to it for each element of an array."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def compact(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize_url(url: Column) -> Column:
    """One spelling per address: lower-case scheme and host, single slashes, no fragment, no tracking or empty parameters, the first value of each other one in order of its key.

    Articles of two news sites and reports of a third have a canonical address of their own.
    """
    raw = compact(url)
    part = lambda pattern, k: F.regexp_extract(raw, pattern, k)
    split = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, query = (part(split, k) for k in (1, 2, 3, 4))
    host = F.lower(host)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/+", "/")
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+"))
    key, value = lambda p: F.substring_index(p, "=", 1), lambda p: F.regexp_replace(p, "^[^=]*=", "")
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: key(q) == key(p)))
    page = host.contains("finance.naver.com") & F.lower(path).rlike("(company|industry)_read\\.naver")
    kept = F.filter(first, lambda p: ~F.lower(key(p)).isin(TRACKING_KEYS) & ~(page & (F.lower(key(p)) == "page")))
    rest = F.array_join(F.array_sort(kept), "&")
    one = lambda name: F.element_at(F.concat(F.transform(F.filter(first, lambda p: key(p) == name), value), F.array(F.lit(""))), 1)
    report = F.regexp_extract(F.lower(path), "(company|industry)_read\\.naver", 1)
    path = F.when(page, F.concat(F.lit("/research/"), report, F.lit("_read.naver"))).otherwise(path)
    plain = F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.lit("://"), host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    article = F.regexp_extract(path, r"/article/(\d{3}/\d+)", 1)
    news = host.contains("news.naver.com")
    return (
        F.when(raw == "", "")
        .when(news & (article != ""), F.concat(F.lit("https://n.news.naver.com/article/"), article))
        .when(news & (one("oid") != "") & (one("aid") != ""), F.concat(F.lit("https://n.news.naver.com/article/"), one("oid"), F.lit("/"), one("aid")))
        .when(host.contains("consensus.hankyung.com") & (one("report_idx") != ""), F.concat(F.lit("https://consensus.hankyung.com/analysis/downpdf?report_idx="), one("report_idx")))
        .when(page & (one("nid") != ""), F.concat(F.lit("https://finance.naver.com/research/"), report, F.lit("_read.naver?nid="), one("nid")))
        .otherwise(plain)
    )


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def content_hash(title: Column, snippet: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit(""))), 256)


def parse_datetime(text: Column, base: Column) -> Column:
    """A moment from "3분 전", "2시간 전", "4일 전" (before base), dates with dots, dashes or slashes, or an ISO time; null if none is there. Times without a zone are UTC."""
    return let(F.trim(text), lambda value: _moment(value, base))


#: Patterns of dates and what a text of that pattern looks like; others are not parsed, as each failure costs an exception.
DATES = {"yyyy.M.d.": r"^[+-]?\d+\.\d+\.\d+\.$", "yyyy.M.d": r"^[+-]?\d+\.\d+\.\d+$", "yyyy-M-d": r"^[+-]?\d+-\d+-\d+$", "yyyy/M/d": r"^[+-]?\d+/\d+/\d+$"}


def _moment(value: Column, base: Column) -> Column:
    ago = lambda unit: F.regexp_extract(value, rf"(\d+)\s*{unit}\s*전", 1).try_cast("int")
    times = [F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(p))) for p, shape in DATES.items()]
    earlier = F.coalesce(F.when(ago("분").isNotNull(), base - F.make_dt_interval(mins=ago("분"))), F.when(ago("시간").isNotNull(), base - F.make_dt_interval(hours=ago("시간"))), F.when(ago("일").isNotNull(), base - F.make_dt_interval(days=ago("일"))))
    return F.coalesce(F.when(F.contains(value, F.lit("전")), earlier), *times, value.try_cast("timestamp"))


def clean_news(text: Column) -> Column:
    """Without tags, short square brackets, reporters in brackets and e-mail addresses."""
    steps = [(r"<[^>]+>", " "), (r"\[[^\]]{1,30}\]", " "), (r"\([^)]*기자[^)]*\)", " "), (r"[\w.+-]+@[\w-]+\.[\w.-]+", " ")]
    return compact(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(text, F.lit(""))))


def paragraphs(text: Column, least: int = 1, most: int = 8) -> Column:
    """The first paragraphs, split at line breaks."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), compact), lambda p: F.length(p) >= least), 1, most)


def lead(text: Column, fallback: Column) -> Column:
    """The first paragraph, else fallback."""
    first = first_of(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda p: compact(p) != "")
    return F.coalesce(let(first, lambda p: F.when(p.isNotNull(), compact(p))), compact(fallback))


def sentences(text: Column, longest: int = 220) -> Column:
    """Sentences in order, each cut at longest characters."""
    parts = F.transform(F.split(compact(text), "(?<=[.!?]) "), lambda s: F.left(F.trim(s), F.lit(longest)))
    return F.filter(parts, lambda s: s != "")


def title_tokens(title: Column) -> Column:
    """Up to 20 words of a title that tell its topic, in order: without brackets, stop words, particles and endings."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), [r"\[[^\]]{1,40}\]", r"\([^)]{1,40}\)", "[^0-9a-z가-힣]+"], F.lower(compact(title)))
    words = F.transform(F.split(F.trim(bare), " +"), _topic_word)
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOP_WORDS)), 1, 20)


def _topic_word(word: Column) -> Column:
    word = F.when((F.length(word) > 3) & word.startswith("한국"), F.substring(word, 3, 1000)).otherwise(word)
    bare = F.regexp_replace(word, f"(?<=..)[{PARTICLES}]+$", "")
    bare = F.regexp_replace(bare, f"(?<=..)(?:{ENDINGS})$", "")
    return F.when(word.rlike("주주총회|주총"), "주총").when(word.contains("거버넌스포럼"), "거버넌스포럼").otherwise(bare)


def title_key(title: Column) -> Column:
    """Up to 12 words of two characters at least, as one string; equal for titles of one cluster."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), [r"\[[^\]]{1,40}\]", r"\([^)]{1,40}\)", "[^0-9a-z가-힣]+"], F.lower(compact(title)))
    return F.array_join(F.slice(F.filter(F.split(F.trim(bare), " +"), lambda w: F.length(w) > 1), 1, 12), " ")


def numeric_context(text: Column) -> Column:
    """Whether a text holds a percentage, an amount of money or a word of results."""
    return let(text, lambda v: reduce(lambda a, w: a | F.contains(v, F.lit(w)), NUMERIC_WORDS, v.rlike(NUMERIC_CONTEXT)))


def fact_tokens(text: Column) -> Column:
    """Dates, percentages, numbers and abbreviations in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FACT_TOKEN), F.lit(0))


def preservation(source: Column, summary: Column) -> Column:
    """Share of the source's fact tokens that the summary holds; 1 without any."""
    bare = lambda c: F.upper(F.regexp_replace(c, r"[\s,]", ""))
    tokens, target = F.transform(fact_tokens(source), bare), bare(F.coalesce(summary, F.lit("")))
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda t: F.contains(target, t))) / F.size(tokens))


def mostly_hangul(text: Column) -> Column:
    """At least 6 Hangul syllables and 1.2 for each Latin letter."""
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.regexp_count(text, F.lit("[가-힣]")) >= F.greatest(F.lit(6), F.floor(latin * 1.2))


def like_title(line: Column, title: Column, tidy: Callable[[Column], Column] = compact) -> Column:
    """Whether a line repeats a title: equal, one within the other, or 0.7 of its words."""
    return let(F.lower(tidy(title)), lambda b: let(F.lower(tidy(line)), lambda a: _repeats(a, b)))


def _repeats(a: Column, b: Column) -> Column:
    shared = let(F.array_distinct(F.split(a, " ")), lambda words: F.size(F.array_intersect(words, F.split(b, " "))) / F.size(words))
    return F.when((a == "") | (b == ""), False).otherwise((a == b) | F.contains(a, b) | F.contains(b, a) | (shared >= 0.7))


def first_of(values: Column, fits: Callable[[Column], Column]) -> Column:
    """The first value of an array of texts that fits, null for none. What comes behind it is not tried."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda a, x: F.when(a.isNotNull(), a).when(fits(x), x))


def one_liner(feed_line: Column, lines: Column, title: Column, fallback: Column, longest: int = 120, tidy: Callable[[Column], Column] = compact) -> Column:
    """The feed line, else the first line that does not repeat the title, else fallback, else the title.

    tidy is applied to lines and title before they are compared. Lines that were cut end in a blank where the cut met one, and it counts as one more word unless tidied away.
    """
    new = lambda x, b: let(tidy(x), lambda v: (v != "") & ~_repeats(F.lower(v), b))
    own = let(F.lower(tidy(title)), lambda b: first_of(lines, lambda x: new(x, b)))
    blank = lambda c: let(compact(c), lambda v: F.when(v != "", v))
    return F.left(F.coalesce(blank(feed_line), blank(own), blank(fallback), compact(title)), F.lit(longest))


def sanitize(line: Column, longest: int = 220) -> Column:
    """One line without investment advice."""
    return let(compact(line), lambda v: F.left(F.when(v.rlike(ADVICE), ADVICE_REPLACEMENT).otherwise(v), F.lit(longest)))


def sanitize_lines(lines: Column, longest: int = 220, most: int = 6) -> Column:
    """Sanitised lines that aren't empty, the first of those that differ by case only, most at most."""
    clean = F.filter(F.transform(lines, lambda x: sanitize(x, longest)), lambda x: x != "")
    first = lambda c: F.filter(c, lambda x, i: ~F.exists(F.slice(c, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(let(clean, first), 1, most)


def section(line: Column) -> Column:
    """The section that a line names before its colon, else null."""
    name = F.lower(F.regexp_extract(compact(line), r"^([A-Za-z가-힣 ]+?)\s*:\s*.+$", 1))
    return F.when(name.isin(SECTIONS), name)


def section_body(line: Column) -> Column:
    return F.when(section(line).isNotNull(), F.regexp_extract(compact(line), r"^[^:]+:\s*(.+)$", 1)).otherwise(compact(line))


def has_all_sections(lines: Column) -> Column:
    return F.forall(F.array(*[F.lit(s) for s in SECTIONS]), lambda s: F.array_contains(F.transform(lines, section), s))


def parse_number(text: Column) -> Column:
    """A number with thousands separators, perhaps a percent sign; null if there is none."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"[-+]?[\d,]*\.?\d+", 0), ",", "").try_cast("double")


def parse_market_cap(text: Column) -> Column:
    """Amounts like "3조 2,000억" in units of one."""
    part = lambda unit: F.coalesce(F.regexp_replace(F.regexp_extract(text, rf"([\d,.]+)\s*{unit}", 1), ",", "").try_cast("double"), F.lit(0.0))
    total = part("조") * 1e12 + part("억") * 1e8
    return F.when(text.rlike(r"\d\s*[조억]"), total).otherwise(parse_number(text))


def percent_of_ratio(value: Column) -> Column:
    """Ratios of at most 1.5 in size become percent."""
    return F.when(F.abs(value) <= 1.5, value * 100).otherwise(value)


def format_market_cap(value: Column) -> Column:
    """T and B from a trillion and a billion on, "-" for null."""
    return F.coalesce(F.when(value >= 1e12, F.format_string("%.2fT", value / 1e12)).when(value >= 1e9, F.format_string("%.2fB", value / 1e9)).when(value.isNotNull(), F.format_string("%.0f", value)), F.lit("-"))


def local_time(moment: Column, market: Column) -> Column:
    """Minutes in the market's own time, "-" for null."""
    zone = F.when(market == "US", "America/New_York").otherwise("Asia/Seoul")
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd HH:mm"), F.lit("-"))


def quote_symbol(code: Column, market: Column, exchange: Column) -> Column:
    """The symbol of a quote service."""
    return F.when(market == "US", F.replace(code, F.lit("."), F.lit("-"))).when(F.upper(exchange) == "KOSDAQ", F.concat(code, F.lit(".KQ"))).otherwise(F.concat(code, F.lit(".KS")))


def source_tag(source: Column, published_at: Column) -> Column:
    return F.when(published_at.isNull(), F.concat(F.lit("["), source, F.lit("]"))).otherwise(F.concat(F.lit("["), source, F.lit(" "), F.date_format(published_at, "yyyy-MM-dd'T'HH:mm"), F.lit("]")))


def pack_words(text: Column, width: int = 110, most: int = 5) -> Column:
    """Words in order packed into lines of at most width characters, most lines."""
    start = F.struct(F.lit("").alias("line"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, w: Column) -> Column:
        full = (a["line"] != "") & (F.length(a["line"]) + 1 + F.length(w) > width)
        return F.struct(F.when(full | (a["line"] == ""), w).otherwise(F.concat(a["line"], F.lit(" "), w)).alias("line"), F.when(full, F.concat(a["out"], F.array(a["line"]))).otherwise(a["out"]).alias("out"))

    packed = F.aggregate(F.split(compact(text), " "), start, step, lambda a: F.filter(F.concat(a["out"], F.array(a["line"])), lambda x: x != ""))
    return F.slice(packed, 1, most)


def body_text(title: Column, snippet: Column, body: Column, longest: int = 6000) -> Column:
    """Title, snippet and body, those that aren't empty, a line each."""
    parts = F.filter(F.array(*[compact(c) for c in (title, snippet, body)]), lambda x: x != "")
    return F.left(F.array_join(parts, "\n"), F.lit(longest))


def last_date_mention(text: Column, as_of: Column) -> Column:
    """The last date in a text that isn't after as_of."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d+\s*(?:분|시간|일)\s*전"), F.lit(0)), lambda x: parse_datetime(x, as_of))
    return F.element_at(F.concat(F.array(F.lit(None).cast("timestamp")), F.filter(found, lambda t: t.isNotNull() & (t <= as_of))), -1)


def bracket_label(title: Column) -> Column:
    return F.regexp_extract(F.coalesce(title, F.lit("")), r"^\s*\[(.+?)\]", 1)


def kind_label(kind: Column) -> Column:
    return F.when(kind == "report", "리포트").when(kind == "filing", "공시").otherwise("뉴스")


def compact_payload(payload: Column, most: int = 10, item: int = 500, whole: int = 1000) -> Column:
    """A JSON object as a map of texts: scalars as they are, lists as JSON lists of most items of item characters at most, anything else cut to whole characters. Other JSON is kept whole under "raw", cut likewise; null for no JSON."""
    short = lambda v: F.to_json(F.transform(F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, most), lambda x: F.left(x.cast("string"), F.lit(item))))
    one = lambda k, v: F.when(F.schema_of_variant(v).startswith("ARRAY"), short(v)).when(F.schema_of_variant(v).startswith("OBJECT"), F.left(F.to_json(v), F.lit(whole))).otherwise(v.cast("string"))
    parsed = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.transform_values(F.try_variant_get(parsed, "$", "map<string,variant>"), one)).when(parsed.isNotNull(), F.create_map(F.lit("raw"), F.left(payload, F.lit(whole))))


def doc_type(raw: Column) -> Column:
    """news, report or filing by its usual names; anything else counts as news."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(low.isin("report", "research"), "report").when(low.isin("filing", "disclosure"), "filing").otherwise("news")


def profile_source_label(source: Column) -> Column:
    """The display name of a profile's source."""
    names = {"manual": "수동 입력", "naver_profile": "네이버 금융", "yahoo_profile": "Yahoo Finance", "derived_docs": "뉴스/리포트 기반"}
    key = F.lower(F.trim(source))
    return F.coalesce(*[F.when(key == k, v) for k, v in names.items()], F.lit("내부 프로필"))


def impact_label(impact: Column) -> Column:
    return F.when(impact == "positive", "긍정").when(impact == "negative", "부정").otherwise("중립")
