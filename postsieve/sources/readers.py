"""Sources: landed files and job-board shapes to canonical rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.banks import BLOCK_WORDS, HEADERS, PORTAL_TITLES, SOURCES
from postsieve.functions.dialect import column
from postsieve.functions.text import title_case
from postsieve.operators.tables import materialise
from postsieve.sources.selectors import select

_S = ["authorName", "authorHeadline", "authorCompany", "text", "postText", "content", "url", "postUrl", "post_url", "link", "postedTime", "publishedAt", "postedAtISO", "time"]
_COUNTS = ["likes", "comments", "reposts", "likeCount", "numLikes", "commentCount", "numComments", "repostCount"]
RAW_POST = T.StructType(
    [T.StructField(c, T.StringType()) for c in _S]
    + [T.StructField("author", T.StructType([T.StructField(c, T.StringType()) for c in ("name", "headline", "company")]))]
    + [T.StructField(c, T.LongType()) for c in ("postedAtTimestamp", "timestamp")]
    + [T.StructField(c, T.StringType()) for c in _COUNTS]
)
#: Canonical column -> aliases in order.
POST_ALIASES = {
    "author_name": ["authorName", "author.name"], "author_headline": ["authorHeadline", "author.headline"], "company": ["authorCompany", "author.company"], "text": ["text", "postText", "content"],
    "url": ["url", "postUrl", "post_url", "link"], "posted_time": ["postedTime", "publishedAt", "time"], "likes": ["likes", "likeCount", "numLikes"], "comments": ["comments", "commentCount", "numComments"], "reposts": ["reposts", "repostCount"],
}
PAGE_ALIASES = POST_ALIASES | {"posted_time": ["postedAtISO", "time", "postedTime"]}


def first_nonblank(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def safe_count(x: Column) -> Column:
    """A list's length, an object's count, else an integer, else 0."""
    return F.coalesce(F.when(x.startswith("["), F.json_array_length(x)), F.when(x.startswith("{"), F.get_json_object(x, "$.count").try_cast("int")), x.try_cast("int"), F.lit(0)).cast("bigint")


def canonical_posts(raw: DataFrame, aliases: dict[str, list[str]] = POST_ALIASES, keep: tuple[str, ...] = ()) -> DataFrame:
    cols = [(safe_count(first_nonblank(*a)) if n in ("likes", "comments", "reposts") else first_nonblank(*a)).alias(n) for n, a in aliases.items()]
    return raw.select(*keep, *cols, F.coalesce(F.nullif("postedAtTimestamp", F.lit(0)), F.col("timestamp")).alias("posted_ms"))


def read_raw_posts(spark: SparkSession, path: str, aliases: dict[str, list[str]] = POST_ALIASES) -> DataFrame:
    """Posts of JSON arrays or lines; aliases are coalesced, blank counting as missing."""
    return canonical_posts(spark.read.schema(RAW_POST).json(path, multiLine=True), aliases)


ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "company", "location", "url", "posted_time", "posted_date", "role", "author_name", "post_text")])


def load_sources(spark: SparkSession, paths: dict[str, str], sources=SOURCES, lines: bool = False) -> DataFrame:
    """Union of the sources' JSON files (arrays, or a row a line), tagged with source and priority.

    A missing file adds no rows, nor does one that isn't JSON.
    """
    out = spark.createDataFrame([], T.StructType([*ITEM.fields, T.StructField("source", T.StringType()), T.StructField("priority", T.LongType())]))
    for name, priority, _ in sources:
        if name in paths:
            reader = spark.read.schema(ITEM).option("ignoreMissingFiles", "true").option("mode", "DROPMALFORMED")
            try:
                rows = reader.json(paths[name], multiLine=not lines)
            except AnalysisException as e:
                if not _missing(e):
                    raise
                continue
            out = out.unionByName(rows.withColumn("source", F.lit(name)).withColumn("priority", F.lit(priority).cast("bigint")))
    return out


def snake(header: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and k and not header[k - 1].isupper() and header[k - 1] != " " else c.lower() for k, c in enumerate(header)).replace(" ", "_")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The 19-column CSV with embedded newlines; rows without a title go, short rows are padded with blanks."""
    schema = T.StructType([T.StructField(snake(h), T.StringType()) for h in HEADERS])
    d = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE", enforceSchema=True)
    return d.fillna("").filter(F.trim("title") != "")


def read_run_metrics(df: DataFrame) -> DataFrame:
    """The last run of (run_at, scanned, rejected, added) strings; bad numbers are 0; empty if the first column isn't run_at."""
    if [c.strip().lower() for c in df.columns][:1] != ["run_at"]:
        return df.limit(0)
    n = lambda c: F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0)).alias(c)
    last = df.select("run_at", n("scanned"), n("rejected"), n("added")).agg(F.max_by(F.struct("run_at", "scanned", "rejected", "added"), "run_at").alias("m"))
    return last.filter("m IS NOT NULL").select("m.*")


def company_page_posts(df: DataFrame) -> DataFrame:
    """Posts of company pages: text and url required, likes and comments summed, the author's type fixed."""
    d = df.filter("coalesce(text, '') <> '' AND coalesce(url, '') <> ''")
    return d.withColumn("engagement", (F.coalesce("likes", F.lit(0)) + F.coalesce("comments", F.lit(0))).cast("bigint")).withColumn("author_type", F.lit("Company"))


def flatten_items(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON items: lists are flattened, objects kept only with a title."""
    item = "struct<title:string,company:string,url:string>"
    many = F.when(F.col(value).startswith("["), F.from_json(value, f"array<{item}>")).otherwise(F.array(F.from_json(value, item)))
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.inline(many)).filter("title IS NOT NULL")


def from_lever(df: DataFrame, company: str) -> DataFrame:
    """Rows {text, categories: {location}, hostedUrl}."""
    name = column(title_case, f"'{company}'")
    return df.select(F.col("text").alias("title"), name.alias("company"), F.coalesce(F.nullif("categories.location", F.lit("")), F.lit("Not specified")).alias("location"), F.col("hostedUrl").alias("url"), F.lit("Lever").alias("ats"))


def from_greenhouse(df: DataFrame, company: str) -> DataFrame:
    """One object {jobs: [{title, location: {name}, absolute_url}]} a row."""
    j = df.select(F.explode("jobs").alias("j"))
    name = column(title_case, f"'{company}'")
    return j.select(F.col("j.title").alias("title"), name.alias("company"), F.coalesce(F.nullif("j.location.name", F.lit("")), F.lit("Not specified")).alias("location"), F.col("j.absolute_url").alias("url"), F.lit("Greenhouse").alias("ats"))


def from_property_bag(df: DataFrame, bag: str = "properties") -> DataFrame:
    """Typed properties by name; title from Title, Role or Name, url from URL, Link or Apply Link; kept with both."""
    p = lambda n: F.col(bag)[n]
    title = lambda n: F.nullif(F.array_join(F.transform(p(n)["title"], lambda x: x["plain_text"]), ""), F.lit(""))
    text = lambda n: F.coalesce(F.when(p(n)["type"] == "select", p(n)["select"]["name"]), F.nullif(F.array_join(F.transform(p(n)["rich_text"], lambda x: x["plain_text"]), ""), F.lit("")))
    d = df.select(
        F.coalesce(title("Title"), title("Role"), title("Name")).alias("title"), F.coalesce(*[F.nullif(p(n)["url"], F.lit("")) for n in ("URL", "Link", "Apply Link")]).alias("url"),
        F.coalesce(text("Company"), F.lit("Unknown")).alias("company"), F.coalesce(text("Location"), F.lit("Not specified")).alias("location"),
    )
    return d.filter("title IS NOT NULL AND url IS NOT NULL")


def assemble_page_text(blocks: DataFrame) -> DataFrame:
    """Ordered text of a page's paragraphs and first headings; other blocks are left out."""
    piece = F.when(F.col("type") == "paragraph", F.concat("plain_text", F.lit("\n"))).when(F.col("type") == "heading_1", F.concat(F.lit("\n# "), "plain_text", F.lit("\n")))
    d = blocks.withColumn("piece", piece).filter("piece IS NOT NULL").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("idx", "piece"))).alias("p"))
    return d.select("page_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def site_of(url: str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A table of sites: name, url, and the selectors of their cards, titles and links (null: `a`), from JSON lines or arrays."""
    return spark.read.schema("name string, url string, cards string, titles string, links string").option("multiLine", True).json(path)


def sites_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, url string, cards string, titles string, links string")


#: Pages that a task holds the elements of at once.
_PAGES_AT_ONCE = 64
#: More sites than this aren't sent to every task.
MAX_SITES = 100_000


def _elements(pages: DataFrame, cards: str, titles: str = "h1", links: str = "a", sites: DataFrame | None = None, text: bool = True, closed: bool = False) -> DataFrame:
    """(page_id, url, site, idx, text, title, href) of the elements of each page in order.

    href: the address of the first link, blank if it has none, null without a link. With sites, pages of their hosts only,
    each by the selectors of its site and under its name; sites of one host each get the page. Without, all pages by the
    given selectors, under their hosts. text: false leaves the texts null; closed: as select takes it.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("site", pa.string()), ("idx", pa.int64()), ("text", pa.string()), ("title", pa.string()), ("href", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAGES_AT_ONCE):
                out = []
                for page, url, site, html, *by in zip(*(c.to_pylist() for c in batch.slice(at, _PAGES_AT_ONCE).columns), strict=True):
                    out += [(page, url, site, k, c.text if text else None, c.title, c.link) for k, c in enumerate(select(html, *by, closed))]
                cols = list(zip(*out, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    d = pages.select(F.col("page_id").cast("bigint"), "url", "html", site_of("url").alias("_host"))
    if sites is None:
        d = d.select("page_id", "url", F.col("_host").alias("site"), "html", F.lit(cards).alias("cards"), F.lit(titles).alias("titles"), F.lit(links).alias("links"))
    else:
        by = sites.select(site_of("url").alias("_host"), F.col("name").alias("site"), "cards", "titles", F.coalesce("links", F.lit(links)).alias("links"))
        by = materialise(by, "sites")
        d = d.join(F.broadcast(by) if by.count() <= MAX_SITES else by, "_host").select("page_id", "url", "site", "html", "cards", "titles", "links")
    return d.mapInArrow(run, "page_id bigint, url string, site string, idx bigint, text string, title string, href string")


def _first_of_site(d: DataFrame, n: int) -> DataFrame:
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("page_id", "idx"))).filter(F.col("_n") <= n).drop("_n")


def _host(url: str) -> Column:
    return F.regexp_extract(url, "^[^/]*//[^/]*", 0)


def _has_word(c: str, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))


def extract_cards(pages: DataFrame, cards: str = "article", titles: str = "h2, h3", links: str = "a", per_site: int = 15, sites: DataFrame | None = None, closed: bool = False) -> DataFrame:
    """Of the first cards of each site those with a title of 5 characters or more, cut at 200.

    cards, titles and links are selectors; sites, a table as read_sites gives it, has those of each site and its name.
    closed: character references count only with their semicolon.

    Addresses: absolute ones stay, those from the root get the site's, others the page's; blank without a link.
    """
    d = _first_of_site(_elements(pages, cards, titles, links, sites, text=False, closed=closed), per_site).filter(F.length("title") >= 5)
    link = F.when(F.col("href").isNull(), "").when(F.col("href").startswith("http"), F.col("href")).when(F.col("href").startswith("/"), F.concat(_host("url"), "href"))
    return d.select("page_id", "idx", F.substring("title", 1, 200).alias("title"), F.lit("See listing").alias("company"), F.lit("India").alias("location"), link.otherwise(F.concat(F.rtrim("url", F.lit("/")), F.lit("/"), "href")).alias("url"), F.col("site").alias("source"))


def extract_blocks(pages: DataFrame, words: tuple[str, ...] = tuple(BLOCK_WORDS), per_site: int = 10) -> DataFrame:
    """Texts of article, div and li of 50 to 3000 characters that hold a keyword, each once a site, the first of a site."""
    d = _elements(pages, "article, div, li").filter(F.length("text").between(50, 3000) & _has_word("text", words))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("site", "text").orderBy("page_id", "idx"))).filter("_n = 1").drop("_n")
    href = F.coalesce(F.nullif("href", F.lit("")), F.col("url"))
    link = F.when(href.startswith("http"), href).otherwise(F.concat("url", href))
    return _first_of_site(d, per_site).select("page_id", "idx", "text", link.alias("url"), F.col("site").alias("source"), F.lit("Today").alias("posted_time"))


def gov_cards(pages: DataFrame, words: tuple[str, ...] = tuple(PORTAL_TITLES), cards: str = "article", titles: str = "h3, h4", links: str = "a[href]", per_site: int = 10, sites: DataFrame | None = None, closed: bool = False) -> DataFrame:
    """Of the first cards of each portal those with a title of 5 characters or more that holds a keyword, cut at 200.

    Selectors, sites and closed as in extract_cards. The company is the portal; addresses that aren't absolute get the portal's in front, a missing one is the page's.
    """
    d = _first_of_site(_elements(pages, cards, titles, links, sites, text=False, closed=closed), per_site).filter((F.length("title") >= 5) & _has_word("title", words))
    href = F.coalesce("href", F.lit(""))
    link = F.when(href == "", F.col("url")).when(href.startswith("http"), href).otherwise(F.concat(_host("url"), href))
    return d.select("page_id", "idx", F.substring("title", 1, 200).alias("title"), F.col("site").alias("company"), F.lit("India").alias("location"), link.alias("url"), F.lit("Government").alias("source"))


def _missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "").split(".")[0] in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_with_fallback(spark: SparkSession, primary: str, seed: str, schema: T.StructType) -> DataFrame:
    """The first of two Parquet tables that can be opened, else an empty one."""
    for path in (primary, seed):
        try:
            return spark.read.schema(schema).parquet(path).select(*schema.names)
        except AnalysisException as e:
            if not _missing(e):
                raise
    return spark.createDataFrame([], schema)
