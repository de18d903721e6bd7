"""Secret scans with a trigram inverted index (DataFrame operations only).

1. Each rule's regular expression gives a Boolean trigram query (``trigrams.trigram_query``).
2. The index: for each chunk of the documents (about ``chunk`` of them, by a hash of the key) a posting list of each trigram that
   some rule asks for, over the lower-cased texts. A trigram that every document has is a list a chunk, never one hot key.
3. A rule's query is evaluated on the lists of a chunk: an alternative intersects the postings of its trigrams, a
   clause unites its alternatives, the rule intersects its clauses; what is left are its candidates.
4. One more scan of the texts runs a rule's expression where a filter of bounded size holds the text's key with the rule;
   the expression verifies, so what passes wrongly has no spans. No text moves or is joined. A rule without a mandatory
   trigram (hex runs) scans every text.

Spans are [start, end) in code points: ``split`` gives the gaps between matches and ``regexp_extract_all``
the matches, both leftmost and non-overlapping, so running lengths give the places.

A PEM key ends at its END line; without one at the end of its base64 block, and then words after the block count to it, up
to the first other character.

Defined cases: null and empty text have no spans; repeated rows are scanned as one text each; a null doc_id is
scanned as any other; an empty table gives an empty result. Further columns
pass through, but for those whose names start with ``secret_``, which are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import let, materialize
from tallyloom.llm.idfilter import pair_filter
from tallyloom.llm.trigrams import trigram_query


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str  # syntax common to Java, RE2 and Python
    group: int = 0  # whose length counts
    least: int = 0  # shorter matches are dropped after matching
    base: bool = False


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")

_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_PEM_END = r"[^-]*(?:Proc-Type:[^-]*)?(?:DEK-Info:\x20*[A-Za-z0-9-]+[^-]*)?-----END [A-Z ]*PRIVATE KEY-----"
_PEM_HEADERS = r"(?:[\x20\t\r\n\\nr]*Proc-Type:[^-]*DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+)?"
# No repeated groups: Java's matcher recurses in them, and a long block would overflow its stack.
_PEM_BLOCK = r"[\x20\t\r\n\\nr]*(?:[A-Za-z0-9+/]{40,}[A-Za-z0-9+/=\x20\t\r\n\\]*|[A-Za-z0-9+/=]*[\x20\t\r\n]*$)"

#: The three base kinds, then formats of widely used credentials.
RULES = [
    SecretRule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),  # the same matches as of AKIA[A-Z0-9]+ with 20 characters or more
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # and of [0-9a-f]+ with 24 or more, without the shorter runs
    SecretRule("pem", f"{_PEM}(?:{_PEM_END}|{_PEM_HEADERS}{_PEM_BLOCK})?"),
    SecretRule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    SecretRule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@?#]{1,}:[^\x00-\x20/:@?#]{3,}@"),
]


PART = 256  # matches that are put in one array at a time


def _places(text: Column, rule: SecretRule, number: int) -> Column:
    """array<struct<start, rule, end>> of the matches that are long enough."""
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    empty = F.array().cast("array<struct<start:long,rule:int,end:long>>")
    none = F.array().cast("array<array<struct<start:long,rule:int,end:long>>>")
    row = F.arrays_zip(gaps.alias("g"), found.alias("f"), counted.alias("c"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["f"]), F.lit(0))
        hit = F.array(F.struct(start.cast("long").alias("start"), F.lit(number).alias("rule"), end.cast("long").alias("end")))
        keep = x["f"].isNotNull() & (F.length(x["c"]) >= rule.least)
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def spans(rows: Column) -> Column:
        # An array is copied when it grows: matches are gathered by parts, so that many of them cost no square.
        def part(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), empty.alias("out"))
            return let(
                F.aggregate(F.slice(rows, i * PART + 1, F.lit(PART)), begin, add),
                lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")),
            )

        begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), begin, part, lambda acc: F.flatten(acc["out"]))

    return F.when(text.rlike(rule.pattern), let(row, spans)).otherwise(empty)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def candidates(docs: DataFrame, rules: list[SecretRule], chunk: int = 20_000) -> DataFrame:
    """(secret_key, secret_rules): numbers of the rules whose trigram query a document satisfies."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    if not wanted:
        return docs.select(_key().alias("secret_key"), F.array().cast("array<int>").alias("secret_rules")).limit(0)
    has = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    postings = docs.where("text is not null").select(_key().alias("secret_key"), F.lower("text").alias("low")).select("secret_key", F.explode(has).alias("trigram"))
    postings = materialize(postings, "secret-postings")
    # About five postings a document: a chunk's lists hold as many keys, whatever the corpus.
    chunks = max(1, -(-postings.count() // (5 * chunk)))
    lists = postings.groupBy(F.pmod("secret_key", F.lit(chunks)).alias("chunk"), "trigram").agg(F.collect_set("secret_key").alias("keys"))
    index = lists.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("index"))
    none = F.array().cast("array<bigint>")

    def meet(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = F.array_intersect(out, c)
        return out

    def answer(index: Column, query) -> Column:
        posting = lambda t: F.coalesce(F.try_element_at(index, F.lit(t)), none)
        clauses = []
        for clause in query:
            alternatives = [meet([posting(t) for t in sorted(alt)]) for alt in clause]
            clauses.append(F.array_distinct(F.flatten(F.array(*alternatives))))
        return meet(clauses)

    found = F.array(*[F.struct(F.lit(i).alias("rule"), answer(F.col("index"), q).alias("keys")) for i, q in queries.items()])
    hits = index.select(F.explode(found).alias("hit")).select("hit.rule", F.explode("hit.keys").alias("secret_key"))
    return hits.groupBy("secret_key").agg(F.collect_set("rule").alias("secret_rules"))


def scan(docs: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """``docs`` with secret_spans: array<struct<start, rule, end>>, in order of start, then of the rules."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("secret_")])
    known = materialize(candidates(docs.select("doc_id", "text"), rules), "secret-candidates")
    pairs = known.select("secret_key", F.explode("secret_rules").alias("rule"))
    word, holds = pair_filter(pairs, "secret_key", "rule", F.col("secret_key"))
    asked = F.array(*[F.lit(i) for i, r in enumerate(rules) if trigram_query(r.pattern)]).cast("array<int>")
    d = docs.withColumn("secret_key", _key()).withColumn("secret_word", word)
    d = d.withColumn("secret_rules", F.filter(asked, lambda i: holds(F.col("secret_word"), i)))
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<start:long,rule:int,end:long>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _places(text, r, i)
        parts.append(F.when(F.array_contains("secret_rules", i), spans).otherwise(empty) if trigram_query(r.pattern) else spans)
    return d.select(*docs.columns, F.sort_array(F.concat(*parts)).alias("secret_spans"))


def shown(spans: Column, rules: list[SecretRule] = RULES) -> Column:
    """kind:start:end joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by a mark."""

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, add, rest)).otherwise(text)


def report(docs: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """The counts and digests of each row's spans."""
    s = scan(docs.select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["rule"] == [r.kind for r in rules].index(kind))).cast("long")
    base = F.filter("secret_spans", lambda x: x["rule"].isin([i for i, r in enumerate(rules) if r.base]))
    return s.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(base, rules).cast("binary"), 256).alias("base_sha256"), shown(F.col("secret_spans"), rules).alias("spans"),
    )


def oracle(rules: list[SecretRule] = RULES) -> str:
    """DuckDB SQL for ``report``: every rule over every text, without the index."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    cols = []
    for i, r in enumerate(rules):
        p = quote(r.pattern)
        cols.append(f"string_split_regex(t, {p}) as g{i}, regexp_extract_all(t, {p}) as f{i}, regexp_extract_all(t, {p}, {r.group}) as c{i}")
    spans = []
    for i, r in enumerate(rules):
        start = f"(list_sum(list_transform(g{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f{i}[1:k-1], lambda x: length(x))), 0))::bigint"
        one = f"{{'start': {start}, 'rule': {i}, 'end': {start} + length(f{i}[k])}}"
        keep = f"list_filter(range(1, len(f{i}) + 1), lambda k: length(c{i}[k]) >= {r.least})"
        spans.append(f"list_transform({keep}, lambda k: {one})")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    show = lambda s: f"coalesce(list_aggregate(list_transform({s}, lambda x: {kinds}[x.rule + 1] || ':' || x.start || ':' || x['end']), 'string_agg', ','), '')"
    n = lambda i: f"len(list_filter(s, lambda x: x.rule = {i}))::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, {", ".join(cols)} from d),
p as (select doc_id, list_sort(list_concat({", ".join(spans)})) as s from m)
select doc_id, {n(0)} as n_assign, {n(1)} as n_access, {n(2)} as n_hex,
       sha256({show("list_filter(s, lambda x: x.rule < 3)")}) as base_sha256, {show("s")} as spans
from p
"""
