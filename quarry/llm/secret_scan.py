"""Secret scans over a trigram inverted index; DataFrame functions only.

Each rule is a Java regular expression, from which `trigram_query` derives its Boolean trigram query. The index
holds postings (trigram, row) of the trigrams that some query asks for, each task's postings sorted by trigram.
Postings of a row are intersected by `candidates`: rows that satisfy a rule's query. Only these are verified with
its regex; a rule without mandatory trigrams scans every text.

Texts stay where they are: candidates are keyed by a 128-bit hash of the text, and a bit filter of these keys,
FILTER_WORDS words of 64 bits at most, tells every task which of its texts may be candidates. Only those are
joined with the candidates, by whatever join their number asks for; the others aren't shuffled.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged
from .tables import lowered, row_key, text_of, unique_name
from .trigram_query import trigram_query, trigrams_of

#: 64-bit words of the candidates' filter at most; a row of it takes some 24 bytes of a broadcast.
FILTER_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """kind; regex; least: shortest match, or shortest group `counted`, in characters."""
    kind: str
    regex: str
    least: int = 0
    counted: int = 0

    @property
    def query(self):
        return trigram_query(self.regex)


#: The contract's three base patterns. Runs of hex digits are taken whole from their
#: first digit on, so asking for 16 at once finds the same runs without listing the short ones.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Formats that issuers of credentials document; spans of these are added to the base ones.
#: A URL's user may be empty and its password of any length. Neither holds white space, @ or /; a user holds no :, ?, #,
#: quote or angle bracket, a password not both one of the last two and a colon.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url", r"""[a-z][a-z0-9+.-]{1,20}://[^\s:@/?#"<>]*:(?:[^\s:@/]+|[^\s@/"<>]+)@"""),
)
RULES = BASE + MORE


def query_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that the rules' queries ask for."""
    return sorted(set().union(*(trigrams_of(r.query) for r in rules)))


def compiled(query, present) -> Column:
    """A trigram query as a Boolean column over present(trigram)."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return present(query)
    out = None
    for q in query[1]:
        part = compiled(q, present)
        out = part if out is None else out & part if query[0] == "and" else out | part
    return out


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Postings (trigram, row) of docs: map-only, each task sorts its own by trigram, so that a reader
    that asks for a trigram skips the row groups without it. row is the text's key; equal texts are one row."""
    rows = docs.select(row_key(text).alias("row"), lowered(text_of(text)).alias("t"))
    has = F.filter(F.array(*[F.when(F.contains(F.col("t"), F.lit(w)), F.lit(w)) for w in query_trigrams(rules)]).cast("array<string>"), lambda x: x.isNotNull())
    return staged(rows.select("row", F.explode(has).alias("trigram")).sortWithinPartitions("trigram"), "postings").select("trigram", "row")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, rules): numbers, as bits, of the rules whose query a row's postings satisfy; rows without any are left out.

    Postings of a row meet as bits, combined before and after they are shuffled."""
    number = {t: k for k, t in enumerate(query_trigrams(rules))}
    words = -(-len(number) // 62)
    masks = [F.bit_or(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for t, k in number.items() if k // 62 == w for x in (t, 1 << (k % 62))]), F.col("trigram")), F.lit(0)).cast("long")).alias(f"m{w}") for w in range(words)]
    merged = postings.groupBy("row").agg(*masks) if masks else postings.select("row").limit(0)
    present = lambda t: F.col(f"m{number[t] // 62}").bitwiseAND(F.lit(1 << (number[t] % 62))) != 0
    bits = F.lit(0)
    for k, rule in enumerate(rules):
        if rule.query is not True:
            bits = bits + F.when(compiled(rule.query, present), F.lit(1 << k)).otherwise(F.lit(0))
    return merged.select("row", bits.cast("long").alias("rules")).filter("rules <> 0")


def _marked(docs: DataFrame, found: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """docs with a key `row`, split: those that found (row, rules) may name, with `row`_rules (null if it doesn't), and the others."""
    place = lambda key: key["a"].bitwiseAND(F.lit(64 * FILTER_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = found.select(place(F.col("row")).alias("p")).groupBy(F.shiftright("p", 6).alias(row + "_word")).agg(F.bit_or(bit).alias(row + "_bits"))
    rows = docs.join(F.broadcast(words), F.shiftright(place(F.col(row)), 6) == F.col(row + "_word"), "left")  # FILTER_WORDS rows at most
    may = F.coalesce(F.getbit(row + "_bits", place(F.col(row)).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    found = found.select(F.col("row").alias(row), F.col("rules").alias(row + "_rules"))
    return rows.filter(may).drop(row + "_word", row + "_bits").join(found, row, "left"), rows.filter(~may).drop(row + "_word", row + "_bits")


_SPANS = "array<struct<start:int,kind:string,end:int>>"


def spans_of(text: Column, found: Column, rule: Rule) -> Column:
    """Spans of a rule's matches `found` in text, those that are long enough.

    The pieces between matches and the matches themselves alternate, so their lengths, in code points,
    add up to positions."""
    groups = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.counted)) if rule.counted else found
    gaps = F.transform(F.split(text, rule.regex, -1), lambda p: F.length(p))
    step = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"), F.transform(groups, lambda m: F.length(m)).alias("counted"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc, s):
        start = acc["at"] + s["gap"]
        end = start + F.coalesce(s["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["counted"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(step, zero, add, lambda acc: acc["out"])


def _verified(rows: DataFrame, whole: Column, rules: tuple[Rule, ...], named: str | None, output: str, stem: str) -> DataFrame:
    """rows with `output`, the spans of all rules that scan, and of those that the bits of column `named` name."""
    # First every rule's matches, a column each, so that no expression is evaluated twice.
    matches = {}
    for k, rule in enumerate(rules):
        every = F.regexp_extract_all(whole, F.lit(rule.regex), F.lit(0))
        if rule.query is True:
            matches[k] = every
        elif named is not None:
            matches[k] = F.when(F.col(named).bitwiseAND(F.lit(1 << k)) != 0, every)
    none = F.array().cast(_SPANS)
    rows = rows.withColumns({f"{stem}_{k}": m for k, m in matches.items()})
    spans = [F.when(F.size(f"{stem}_{k}") > 0, spans_of(whole, F.col(f"{stem}_{k}"), rules[k])).otherwise(none) for k in matches]
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    merged = F.transform(F.concat(none, *spans), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    sorted_spans = F.transform(F.array_sort(merged), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.withColumn(output, sorted_spans).drop(*[f"{stem}_{k}" for k in matches])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", output: str = "secrets") -> DataFrame:
    """docs with `output`: array<struct<start, kind, end>>, by start, then by the rules' order, then end.

    Whole texts; null as empty, and equal rows each get their spans. Matches of different kinds may overlap;
    positions are code points, the end exclusive. A column of that name is replaced.
    """
    docs = docs.drop(output)
    row = unique_name(docs, "_scan_row")
    found = staged(candidates(build_index(docs, rules, text), rules), "candidates")
    may, others = _marked(docs.withColumn(row, row_key(text)), found, row)
    whole = text_of(text)
    parts = [_verified(may, whole, rules, row + "_rules", output, row), _verified(others, whole, rules, None, output, row)]
    return parts[0].drop(row + "_rules").unionByName(parts[1]).drop(row)


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
