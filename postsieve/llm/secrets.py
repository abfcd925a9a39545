"""Secret scans over a trigram inverted index.

Each rule's regex gives a Boolean trigram query: an OR of ANDs of trigrams that every match must contain. The index
stores (trigram, doc_id) for the trigrams that the rules ask for; postings that meet for all trigrams of an AND make a
candidate, and only candidates are matched with the regex. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import carried, materialise, sparse_join, table


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose length must reach min_length, matches that fail being dropped; 0 is the whole match.
    group: int = 0
    min_length: int = 0


#: The base kinds, in the order in which spans of equal starts are listed (fixed values). Runs of one class are greedy, so
#: their least length can stand in the regex; the assignment's can't, as a short value still uses up its text.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further published token shapes, found through the same index.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09-\x0D-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),  # with its body, or the header alone
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment", r"sk_live_[0-9A-Za-z]{16,}"),
)
#: More alternatives than this are not followed up: the literal run ends there.
MAX_ALTERNATIVES = 32


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The OR of ANDs of lower-case trigrams that any match's text contains; empty if none is mandatory."""
    runs: list[set[str]] = []

    def exact(op, arg) -> set[str] | None:
        """The few strings that an element stands for, else None."""
        if op is rc.LITERAL:
            return {chr(arg).lower()} if arg < 128 else None
        if op is rc.IN and all(o is rc.LITERAL and a < 128 for o, a in arg):
            return {chr(a).lower() for _, a in arg}
        if op is rc.SUBPATTERN:
            return whole(arg[3])
        if op is rc.BRANCH:
            found = [whole(x) for x in arg[1]]
            return None if None in found else set().union(*found)
        if op is rc.MAX_REPEAT and arg[:2] == (0, 1):
            one = whole(arg[2])
            return None if one is None else one | {""}
        return None

    def whole(elements) -> set[str] | None:
        out = {""}
        for op, arg in elements:
            one = exact(op, arg)
            if one is None or len(out) * len(one) > MAX_ALTERNATIVES:
                return None
            out = {a + b for a, b in product(out, one)}
        return out

    run = {""}
    for op, arg in rp.parse(regex):
        one = exact(op, arg)
        if one is not None and len(run) * len(one) <= MAX_ALTERNATIVES:
            run = {a + b for a, b in product(run, one)}
            continue
        again = whole(arg[2]) if op is rc.MAX_REPEAT and arg[0] > 0 else None
        if again and len(run) * len(again) <= MAX_ALTERNATIVES:  # once at least, then perhaps more
            run = {a + b for a, b in product(run, again)}
        runs.append(run)
        run = one or again or {""}
    runs.append(run)
    best: list[frozenset[str]] = []
    for run in runs:
        alternatives = {_grams(s) for s in run}
        if frozenset() in alternatives:
            continue
        alternatives = [a for a in alternatives if not any(b < a for b in alternatives)]
        merged = alternatives if not best else [a | b for a, b in product(best, alternatives)] if len(best) * len(alternatives) <= MAX_ALTERNATIVES else best
        best = [a for a in set(merged) if not any(b < a for b in merged)]
    return sorted(best, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id), stored in the shared folder: which of the trigrams a text holds, A-Z lower-cased."""
    low = docs.select("doc_id", F.lower("text").alias("_l"))
    held = F.array_compact(F.array(*[F.when(F.contains("_l", F.lit(t)), F.lit(t)) for t in trigrams]))
    return materialise(low.select(F.explode(held).alias("trigram"), "doc_id").sortWithinPartitions("trigram", "doc_id"), "trigrams")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): for each document the kinds of those rules whose trigram query it fulfils."""
    asked = [(r.kind, k, t, 1 << i, len(a)) for r in rules for k, a in enumerate(trigram_query(r.regex)) for i, t in enumerate(sorted(a))]
    index = trigram_index(docs, sorted({t for _, _, t, _, _ in asked}))
    plan = docs.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, bit bigint, terms int")
    met = index.join(F.broadcast(plan), "trigram")  # the plan's size is that of the rules
    met = met.groupBy("doc_id", "kind", "alternative", "terms").agg(F.bit_or("bit").alias("seen"))
    met = met.filter(F.bit_count("seen") == F.col("terms"))
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, kind_no: int) -> Column:
    """Array of (start, kind, end): a rule's leftmost non-overlapping matches in code points, failing ones dropped."""
    regex = F.lit(rule.regex)
    between, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,checked:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        checked = F.length(F.regexp_extract(x["found"], rule.regex, rule.group)) if rule.min_length else F.lit(0)
        one = F.struct(start.alias("start"), F.lit(kind_no).alias("kind"), end.alias("end"), checked.alias("checked"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(between.alias("between"), found.alias("found"))
    pairs = F.filter(pairs, lambda x: x["found"].isNotNull())
    out = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.regex), F.filter(out, lambda x: x["checked"] >= rule.min_length)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All rows and columns of docs, and secrets: array of (start, kind, end) by start, then kind in the rules' order.

    kind is the rule's place in rules; offsets are code points, end exclusive. Null and empty texts have no secrets.
    Rows that repeat a doc_id, and null doc_ids, are matched each on their own text. An empty table gives an empty
    result. A column of docs named secrets is replaced, others stay. Very long texts are matched whole.
    """
    docs, back = carried(docs, ["doc_id", "text"], ("secrets",))
    indexed = tuple(r for r in rules if trigram_query(r.regex))
    d = docs.withColumn("_kinds", F.array().cast("array<string>"))
    if indexed:
        found = materialise(candidates(docs.select("doc_id", "text"), indexed).withColumnRenamed("kinds", "_kinds"), "candidates")
        d = sparse_join(docs, found, "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,checked:int>>")
    parts = [spans_of(text, r, k) if r not in indexed else F.when(F.array_contains("_kinds", r.kind), spans_of(text, r, k)).otherwise(none) for k, r in enumerate(rules)]
    spans = F.transform(F.sort_array(F.concat(*parts)), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return back(d, spans.alias("secrets"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """docs with the secrets of scan(), merged where they overlap, replaced by [kind] of the first; null texts stay null.

    A column of docs named secrets is left out, as scan() replaces it; others stay, whatever their names.
    """
    names = F.array(*[F.lit(r.kind) for r in rules])
    rows, back = carried(docs, ["doc_id", "text"], ("secrets",))
    d = scan(rows, rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), names[x["kind"]], F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    text = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return back(d.withColumn("text", F.when(F.size("secrets") > 0, text).otherwise(F.col("text"))))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE_RULES + MORE_RULES
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < len(BASE_RULES))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base, rules), 256).alias("base_sha256"), listed(F.col("secrets"), rules).alias("spans"))
