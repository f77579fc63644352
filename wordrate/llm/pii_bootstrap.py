"""Personal data in texts: fixed patterns, and what bootstrapped contexts add.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by fixed
rules.  Their occurrences are the seeds of a bootstrap: the words beside a seed are its
lexical patterns (left word, right word, both), and every other identifier-like string is
a candidate instance of the patterns around it.  Spark scores the graph of patterns and
instances in rounds: a pattern is as reliable as its instances are on average (shrunk
towards nothing by a prior), and an instance takes the reliability of its patterns,
weighted by how often it occurs with each.  Seeds stay at 1.  Occurrences of candidates
in patterns of high confidence become spans of the pattern's kind.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: An identifier-like string: letters, digits and joining marks, five characters or more,
#: with a digit or an at sign among them.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9@+])[+(]?[A-Za-z0-9]*[0-9@][A-Za-z0-9@._%+()/-]*[A-Za-z0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE, _AFTER = 40, 40  # characters searched for the words beside a span


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, by start, then kind."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = s = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((0, s, m.end()))
                end = m.end()
    if _DIGITS.search(text) is None:
        return out
    for m in _IP.finditer(text):
        # a part of many digits is too large whatever its value; int() has a length limit
        if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The nearest words on the same line before and after a span, folded; '' if none."""
    left = text[max(0, start - _BEFORE):start].rsplit("\n", 1)[-1]
    right = text[end:end + _AFTER].split("\n", 1)[0]
    a = _WORD.findall(left)
    b = _WORD.search(right)
    return (a[-1].lower() if a else ""), (b.group().lower() if b else "")


_STRUCT = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string())]))


def occurrences(text: str) -> list[tuple]:
    """Base spans, and with kind -1 the identifier-like strings apart from them, each with
    its value (digits and letters, folded) and the words beside it."""
    base = base_spans(text)
    out = []
    covered = sorted((s, e) for _, s, e in base)
    if _DIGITS.search(text) or "@" in text:
        at = 0
        for m in _IDENTIFIER.finditer(text):
            s, e = m.span()
            if e - s < 5:
                continue
            while at < len(covered) and covered[at][1] <= s:
                at += 1
            if any(a < e and s < b for a, b in covered[at:at + 4]):
                continue
            out.append((-1, s, e))
    return [(k, s, e, re.sub(r"[^a-z0-9@.]", "", text[s:e].lower()), *_beside(text, s, e)) for k, s, e in base + out]


def _scan():
    @F.arrow_udf(_STRUCT)
    def scan(text: pa.Array) -> pa.Array:
        keys = ("kind", "start", "end", "value", "left", "right")
        return pa.array([[dict(zip(keys, o)) for o in occurrences(t)] if t else [] for t in text.to_pylist()], _TYPE)
    return scan(F.col("text").cast("string"))


def patterns(occ: DataFrame, rounds: int = 3, prior: float = 3.0) -> DataFrame:
    """(pattern, kind, confidence, seeds) from ``occ(kind, value, left, right)``.

    The graph's edges are distinct (pattern, instance) pairs with their counts.  A pattern's
    confidence for a kind is the counts-weighted mean of its instances' scores for it, with
    ``prior`` more occurrences of nothing; an instance's score is the mean confidence of its
    patterns, 1 for a seed."""
    edge = (occ.filter("value <> ''")
            .select("kind", "value", F.explode(F.filter(F.array(
                F.when(F.col("left") != "", F.concat(F.lit("L:"), "left")),
                F.when(F.col("right") != "", F.concat(F.lit("R:"), "right")),
                F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B:"), "left", F.lit(" "), "right"))),
                lambda p: p.isNotNull())).alias("pattern"))
            .groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("n")))
    edge = cut_lineage(edge)
    total = edge.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edge.filter("kind >= 0").select("pattern", "kind", "value", "n", F.lit(1.0).alias("score"))
    open_ = edge.filter("kind < 0").select("pattern", "value", "n")
    score = None
    for i in range(rounds):
        support = seeds if score is None else seeds.union(open_.join(score, "value").select("pattern", "kind", "value", "n", "score"))
        conf = (support.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("w"), F.sum(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("seeds"))
                .join(total, "pattern").select("pattern", "kind", (F.col("w") / (F.col("total") + prior)).alias("confidence"), "seeds"))
        if i + 1 < rounds:
            # an instance leans on all its patterns, also those that no seed supports
            weight = open_.groupBy("value").agg(F.sum("n").alias("all"))
            score = (open_.join(conf, "pattern").groupBy("value", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("s"))
                     .join(weight, "value").select("value", "kind", F.least(F.col("s") / F.col("all"), F.lit(0.999)).alias("score")))
            score = cut_lineage(score)
    return conf


def personal_data(docs: DataFrame, rounds: int = 3, min_confidence: float = 0.6, min_seeds: int = 5,
                  keep_text_hash: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, base and spans, arrays of
    struct(start, end, kind) in code points, end exclusive, by start, then kind as listed.

    ``spans`` holds ``base`` and the discovered ones; a discovered string has no overlap
    with a base span and stands in a pattern of one kind with at least ``min_confidence``
    and ``min_seeds`` different seeds.  Null and empty texts have none.  Rows with a null or
    repeated doc_id are rows of their own.  Other columns are ignored; ``keep_text_hash`` adds
    text_hash, the xxhash64 of the text.
    """
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), _scan().alias("occ"))
                       .withColumn("row", F.monotonically_increasing_id()))
    hits = rows.filter(F.size("occ") > 0).select("row", F.explode("occ").alias("o")).select("row", "o.*")
    conf = patterns(hits, rounds).filter((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds))
    best = cut_lineage(conf.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind2"), F.max("confidence").alias("confidence")))
    found = (hits.filter("kind < 0").select("row", "start", "end", F.explode(F.array(
                F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"), F.concat(F.lit("B:"), "left", F.lit(" "), "right"))).alias("pattern"))
             .join(best, "pattern").groupBy("row", "start", "end")
             .agg(F.max_by("kind2", F.struct("confidence", -F.col("kind2"))).alias("kind"))
             .groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more")))
    base = F.transform(F.filter("occ", lambda o: o["kind"] >= 0), lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["kind"].alias("kind")))
    by = lambda a: F.array_sort(a, _by_start_and_kind)
    own = ["doc_id", "text_hash"] if keep_text_hash else ["doc_id"]
    return (rows.join(found, "row", "left")
            .select(*own, by(base).alias("base"), F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:int>>")).alias("more"))
            .select(*own, "base", by(F.concat("base", "more")).alias("spans")))


def _by_start_and_kind(a, b):
    key = lambda x: F.struct(x["start"], x["kind"], x["end"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def named(spans):
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """``docs`` with every span of ``personal_data`` replaced by its kind in brackets, such as
    [EMAIL] (overlapping spans by the first one's kind), and n_chars set to the new length
    where that column is there.  Rows without spans are unchanged."""
    cols = docs.columns
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(cols)], *key, F.xxhash64(F.col("text").cast("string")).alias("hash"))
    # a text decides its spans, so rows are matched by id and text
    spans = (personal_data(docs.select(*key), rounds, keep_text_hash=True).filter(F.size("spans") > 0)
             .select(F.col("doc_id").alias("id"), "text_hash", "spans").dropDuplicates(["id", "text_hash"]))
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    changed = F.col("spans").isNotNull()
    joined = joined.withColumn("text", F.when(changed, _replaced()(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    final = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text"))}
    return joined.select(*[(F.when(changed, final[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"own_{i}")) if c in final else F.col(f"own_{i}")).alias(c)
                           for i, c in enumerate(cols)])


def _replaced():
    @F.arrow_udf("string")
    def replaced(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            if not s:
                out.append(t)
                continue
            parts, at = [], 0
            for x in s:
                if x["start"] >= at:
                    parts += [t[at:x["start"]], f"[{KINDS[x['kind']].upper()}]"]
                at = max(at, x["end"])
            out.append("".join(parts) + t[at:])
        return pa.array(out, pa.string())
    return replaced
