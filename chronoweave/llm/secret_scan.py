"""Secret scanning with a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of clauses, each a choice of
trigram sets. The index has a posting (trigram, text key) for every trigram that any query names and every text that
holds it. Postings of a text are intersected against each rule's query, and only its candidate rules are verified by
their expression; a rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A choice of trigram sets: one of them must be in the text.
Clause = frozenset[frozenset[str]]
#: Literal strings that one part of an expression may expand to before it is cut.
MOST_STRINGS = 64
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds for Java and Python alike. Matches are leftmost and don't overlap; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of 24 or more is the same match as [0-9a-f]+ of that length
)
#: A private key goes to its END line. Without one it goes as far as what can only be its body: header lines, lines of
#: base64 alone, and long runs of base64 with what ends their line; line breaks may be escaped, lines quoted or indented.
#: Repeats are possessive, so a long text costs neither stack nor backtracking.
_BREAK = r"""[\x20\t"',;]*+(?:[\r\n]|\\[nr])(?:[\x20\t\r\n>|"'#*]|\\[nrt])*+"""
_LINE_ENDS = r"""(?=[\x20\t"',;]*+(?![^\r\n\\]))"""
_BODY = (
    rf"""(?:{_BREAK}(?:Proc-Type|DEK-Info|Content-Domain):[^\r\n\\"]*+"""
    rf"""|{_BREAK}[A-Za-z0-9+/=]++{_LINE_ENDS}"""
    r"""|(?:[\x20\t\r\n>|"',;#*]|\\[nrt])*+[A-Za-z0-9+/=]{24,}+"""
    rf"""(?:[\x20\t]++[A-Za-z0-9+/=]++{_LINE_ENDS})?+)*+"""
)
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:[^-]*+(?:-{{1,4}}+[^-]++)*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_BODY})"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[^\s/:@]{1,64}:[^\s/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match of ``pattern`` fulfils in its lower-cased text; none if it has no mandatory trigram."""

    class Walk:
        def __init__(self):
            self.strings, self.clauses = {""}, []

        def flush(self):
            if self.strings and min(map(len, self.strings)) >= 3:
                own = set(map(trigrams, self.strings))
                self.clauses.append(frozenset(x for x in own if not any(y < x for y in own)))  # a choice that needs more than another adds nothing
            self.strings = {""}

        def times(self, choice: set[str]):
            if len(self.strings) * len(choice) > MOST_STRINGS:
                self.flush()
            self.strings = {a + b for a in self.strings for b in choice}

        def exact(self, items) -> set[str] | None:
            """The strings that ``items`` stand for, if these are few."""
            inner = Walk()
            inner.run(items)
            return inner.strings if not inner.clauses and inner.whole else None

        whole = True

        def cut(self):
            self.whole = False
            self.flush()

        def run(self, items):
            for op, arg in items:
                if op is sre.LITERAL:
                    self.times({chr(arg).lower()})
                elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                    self.times({chr(c).lower() for _, c in arg})
                elif op is sre.SUBPATTERN:
                    self.run(arg[-1])
                elif op is sre.BRANCH:
                    own = [self.exact(x) for x in arg[1]]
                    if all(x is not None for x in own):
                        self.times(set().union(*own))
                    else:
                        self.cut()
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                    low, high, inner = arg
                    own = self.exact(inner)
                    if own is not None and high == 1:
                        self.times(own | {""} if not low else own)
                    elif own is not None and low == high and low <= 8:
                        for _ in range(low):
                            self.times(own)
                    else:
                        if low:
                            self.run(inner)
                        self.cut()
                else:
                    self.cut()

    walk = Walk()
    walk.run(sre_parser.parse(pattern))
    walk.flush()
    return walk.clauses


def _key(id_col: str, text_col: str) -> Column:
    """Rows of equal id and text have one key; a clash of other rows only makes a needless candidate."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def trigram_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name; texts are lower-cased for it."""
    named = sorted({t for r in rules for clause in trigram_query(r.pattern) for choice in clause for t in choice})
    own = docs.select(_key(id_col, text_col).alias("key"), F.lower(F.col(text_col).cast("string")).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in named))) if named else F.array().cast("array<string>")
    return own.select("key", F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the indexed rules whose trigram query a text's postings fulfil. A key's postings are as many as the queries' trigrams at most."""
    gathered = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))

    def fulfilled(clauses: list[Clause]) -> Column:
        both = F.lit(True)
        for clause in clauses:
            either = F.lit(False)
            for choice in sorted(map(sorted, clause)):
                either = either | (F.size(F.array_except(F.array(*map(F.lit, choice)), "held")) == 0)
            both = both & either
        return both

    queries = [(r.kind, trigram_query(r.pattern)) for r in rules]
    kinds = F.array_compact(F.array(*(F.when(fulfilled(q), F.lit(kind)) for kind, q in queries if q))) if any(q for _, q in queries) else F.array().cast("array<string>")
    return gathered.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda it is a variable."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, add, kind: str) -> Column:
    """For each of ``values`` (an array of ``kind``) the sum, by ``add``, of those before it and itself; ``zero`` starts it.

    The array is cut into parts of the square root of its size. A fold that appends copies what it has at each step, so
    it runs over the sums of parts, and over each part from the sum before it; never over the whole array.
    """

    def append(acc, x):
        now = add(acc["now"], x)
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    def fold(items, start):
        return F.aggregate(items, F.struct(start.cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("all")), append, lambda acc: acc["all"])

    def over_parts(parts):
        sums = F.transform(parts, lambda part: F.aggregate(part, zero.cast(kind), add))
        starts = F.concat(F.array(zero.cast(kind)), fold(sums, zero))
        return F.flatten(F.transform(parts, lambda part, i: fold(part, F.get(starts, i))))

    def cut(items):
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        parts = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / w).cast("int")), lambda i: F.slice(items, i * w + 1, w)))
        return F.when(F.size(items) > 0, let(parts, over_parts)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(values, cut)


#: A span's place in code points and in bytes of UTF-8, ends exclusive.
SPAN = "struct<start:int,rank:int,end:int,kind:string,byte_start:int,byte_end:int>"
_PLACE = "struct<at:int,byte_at:int>"


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """array of SPAN of the rule's matches, in time that grows little faster than their number."""
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    none = F.array().cast(f"array<{SPAN}>")

    def placed(x):
        sizes = F.transform(F.arrays_zip(x["gaps"].alias("gap"), x["found"].alias("match")), lambda p: F.struct((F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))).alias("at"), (F.octet_length(p["gap"]) + F.coalesce(F.octet_length(p["match"]), F.lit(0))).alias("byte_at")))
        ends = running(sizes, F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte_at")), lambda a, v: F.struct((a["at"] + v["at"]).alias("at"), (a["byte_at"] + v["byte_at"]).alias("byte_at")), _PLACE)

        def span(m):
            end = m["end"]
            parts = {
                "start": end["at"] - F.length(m["match"]), "rank": F.lit(rank), "end": end["at"], "kind": F.lit(rule.kind),
                "byte_start": end["byte_at"] - F.octet_length(m["match"]), "byte_end": end["byte_at"],
            }
            return F.struct(*(c.alias(n) for n, c in parts.items()))

        zipped = F.filter(F.arrays_zip(x["found"].alias("match"), x["value"].alias("value"), ends.alias("end")), lambda m: F.length(m["value"]) >= rule.least)
        return F.transform(zipped, span).cast(f"array<{SPAN}>")

    spans = let(F.struct(gaps.alias("gaps"), found.alias("found"), long_enough.alias("value")), placed)
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def with_spans(docs: DataFrame, name: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``name``: its secrets, array of SPAN by start, then rule.

    Null and empty texts have none. Repeated rows stay. All other columns pass through, whatever their names.
    """
    key, kinds = common.free_name(docs, "__key"), common.free_name(docs, "__kinds")
    found = candidates(trigram_index(docs, rules, id_col, text_col), rules).select(F.col("key").alias(key), F.col("kinds").alias(kinds))
    joined = docs.withColumn(key, _key(id_col, text_col)).join(found, key, "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    per_rule = []
    for rank, rule in enumerate(rules):
        own = match_spans(text, rule, rank)
        per_rule.append(F.when(F.array_contains(kinds, rule.kind), own).otherwise(none) if trigram_query(rule.pattern) else own)
    return joined.withColumn(name, F.array_sort(F.concat(*per_rule))).drop(key, kinds)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans) per row, spans as in with_spans. An empty table gives no rows."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_spans(slim, "spans", rules, "doc_id", "text").select("doc_id", "spans")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the characters of ``spans`` (by start) replaced by ``mark``, once where spans overlap; spans that touch keep a mark each."""

    def pieces(x):
        ends = running(F.transform(x["spans"], lambda s: s["byte_end"]), F.lit(0), lambda a, v: F.greatest(a, v), "int")

        def joined(ends):
            def piece(s, i):
                before = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
                gap = F.substring(x["data"], before + 1, s["byte_start"] - before).cast("string")
                return F.when(s["byte_start"] >= before, F.concat(gap, F.lit(mark))).otherwise("")

            tail = F.get(ends, F.size(ends) - 1)
            return F.concat(F.array_join(F.transform(x["spans"], piece), ""), F.substring(x["data"], tail + 1, F.octet_length(x["data"])).cast("string"))

        return let(ends, joined)

    return F.when(F.size(spans) > 0, let(F.struct(text.cast("binary").alias("data"), spans.alias("spans")), pieces)).otherwise(text)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, mark: str = MARK, length_col: str | None = None) -> DataFrame:
    """``docs`` with each secret's characters replaced by ``mark`` (overlapping secrets by one); rows and columns stay.

    ``length_col`` names a column that holds the text's length and follows a change. Null texts stay null.
    """
    spans = common.free_name(docs, "__spans")
    out = with_spans(docs, spans, rules, id_col, text_col).withColumn(text_col, redacted(F.col(text_col), F.col(spans), mark))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size(spans) > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.drop(spans)


def _has_rank(rank: int):
    return lambda s: s["rank"] == rank


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", _has_rank(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
