"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

A conversation's rows are taken by turn (nulls first).  Per row the edits are Keep (0),
Rerole to user or assistant (1), Delete (2; the only edit of a blank or repeated row);
Insert (5) puts an empty user or assistant row anywhere; a truncated row that stays costs 5
more.  The four states of the role pattern are start, after system, after user and after
assistant; of the cheapest edit strings the ASCII-least one is given, which also fixes
the roles, as a state allows one role of a rerole or an insertion.

The texts stay out of the search.  Each row is a few columns (flags, first letter of the
role, hash of the text); equal rows are one row with a count, since all but the first are
repeats and are deleted.  The rows are put in (conversation, turn) order by ranges and
stored; the part of a conversation in one range is a slice.  A conversation may
span many slices, so no task needs to hold one:

* every slice of a conversation that spans ranges gives its 4 x 4 table of least costs from
  state to state; a conversation's tables, one a range at most, give the cost vector behind
  every slice;
* inside a slice the search stores the backward cost vector only at every sqrt(n)-th row and
  computes the rows between again while it walks forward and picks the least letter;
* a slice that starts in the middle of a conversation walks from every state, and the states
  are linked up when the slices of a conversation are put together.

Texts are shuffled once, beside the edits, to write the repaired rows.

Defined results: a null conversation id is a conversation; null roles and texts read as one
space, so such a text is blank; rows of equal turn are taken by role, then by the
SHA-256 of the text; a role's initial is its first character, of an empty role none.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordrate.operators.numbering import _n_partitions
from wordrate.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# states: 0 start, 1 after system, 2 after user, 3 after assistant
_TURNED = (2, 2, 3, 2)  # state after the one role that a rerole or an insertion may give
_ROLE = ("user", "user", "assistant", "user")
_KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_ENDS = (0, 3)
_FAR = 1 << 60

# a row's code: its first letter if that is s, u or a, else "-"; upper case (or "+"): truncated; "x": to be deleted
_SEEN = r"[^\x20\x09-\x0D]"
_LEGAL = ("su", "ua", "au")


def _inserted(v):
    """Costs to go when rows may be inserted first."""
    two = [INSERT + v[_TURNED[s]] for s in range(4)]
    return tuple(min(v[s], two[s], INSERT + two[_TURNED[s]]) for s in range(4))


def _choices(code):
    """(cost of a row that stays, states after keeping it)."""
    more = TRUNCATED if code.isupper() or code == "+" else 0
    return more, _KEPT.get(code.lower(), (-1,) * 4)


def _before(code, n, v):
    """Costs to go before a row and its n - 1 repeats, from those after (closed under insertions)."""
    if code == "x":
        return tuple(c + DELETE * n for c in v)
    v = [c + DELETE * (n - 1) for c in v]
    more, kept = _choices(code)
    return _inserted([min(v[s] + DELETE, v[_TURNED[s]] + REROLE + more, v[kept[s]] + KEEP + more if kept[s] >= 0 else _FAR)
                      for s in range(4)])


def costs(codes, counts, after) -> tuple:
    """Costs to go before the first row."""
    for code, n in zip(reversed(codes), reversed(counts)):
        after = _before(code, n, after)
    return after


def walk(codes, counts, after, state: int):
    """(letters, state before) of every row, insertions before it included: the ASCII-least of the
    cheapest edits.  The state behind the last row comes last, with no letters.

    Cost vectors are kept at every sqrt(n)-th row only; those of one stretch are computed
    again when the walk enters it.
    """
    size = len(codes)
    step = max(1, isqrt(size))
    marks = {size: after}
    v = after
    for i in range(size - 1, -1, -1):
        v = _before(codes[i], counts[i], v)
        if i % step == 0:
            marks[i] = v
    for low in range(0, size, step):
        high = min(low + step, size)
        table = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            table.append(_before(codes[i], counts[i], table[-1]))
        table.reverse()
        for i in range(low, high):
            code, n, letters, entered = codes[i], counts[i], "", state
            if code == "x":
                yield "D" * n, state
                continue
            here = table[i - low]
            then = [c + DELETE * (n - 1) for c in table[i - low + 1]]
            more, kept = _choices(code)
            while here[state] != then[state] + DELETE and here[state] == here[_TURNED[state]] + INSERT:
                letters, state = letters + "I", _TURNED[state]
            if here[state] == then[state] + DELETE:
                letters += "D"
            elif kept[state] >= 0 and here[state] == then[kept[state]] + KEEP + more:
                letters, state = letters + "K", kept[state]
            else:
                letters, state = letters + "R", _TURNED[state]
            yield letters + "D" * (n - 1), entered
    yield "", state


def _closing(state: int) -> list[str]:
    """Roles to insert behind the last row."""
    roles = []
    while state not in _ENDS:
        roles.append(_ROLE[state])
        state = _TURNED[state]
    return roles


# --- damage (conversations to try the repair on) -----------------------------------------

def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults chosen by crc32(``conv_id:turn``) % 20: 0 drops a
    row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user.
    Nulls are read as one space, those of conv_id and turn in the checksum only."""
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _shown("role").alias("role"), _shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# --- rows and slices -----------------------------------------------------------------------

_KEY = ["conv", "turn", "role", "sha"]


def _own(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    own = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), _shown(role).alias("role"), _shown(text).alias("text"))
    return own.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _coded(own: DataFrame) -> DataFrame:
    """One row per distinct key: n equal rows, the role's first letter, the fault and the code of
    the first of them."""
    last = F.substring(F.rtrim("text", F.lit("\t\n\x0b\x0c\r ")), -1, 1)
    facts = own.select(*_KEY, (~F.col("text").rlike(_SEEN)).alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    facts = facts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open"))
    # the first turn at which a role and text occur; null comes before all
    first = facts.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("sha").alias("sha_")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("sha") == F.col("sha_"))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    code = F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(F.translate(letter, "-", "+"))).otherwise(letter)
    return facts.join(first.hint("merge"), same).select(*_KEY, "n", initial.alias("initial"), fault.alias("fault"), code.alias("code"))


def _ranged(coded: DataFrame) -> DataFrame:
    """The rows in order, cut into ranges: part, and seq, which rises with the order."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    ranged = coded.repartitionByRange(_n_partitions(coded, None), *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))


def _slices(batches):
    """The slices of a partition as dicts of column -> values, in order."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        conv = columns["conv"]
        cuts = [0] + [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]] + [len(conv)]
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and now["conv"][0] == conv[a]:
                for name, values in columns.items():
                    now[name].extend(values[a:b])
            else:
                if now is not None:
                    yield now
                now = {name: values[a:b] for name, values in columns.items()}
    if now is not None:
        yield now


def _tables(batches):
    """Least costs of a slice from state to state, one vector for each state behind it."""
    for s in _slices(batches):
        table = [costs(s["code"], s["n"], _inserted([0 if t == e else _FAR for t in range(4)])) for e in range(4)]
        yield pa.RecordBatch.from_pydict({"seq": [s["seq"][0]], "table": pa.array([table], pa.list_(pa.list_(pa.int64())))})


def _after(batches):
    """From a conversation's slices in order: the costs to go behind each of them."""
    for batch in batches:
        for slices in batch.column(0).to_pylist():
            v, out = _inserted([0 if s in _ENDS else _FAR for s in range(4)]), []
            for s in reversed(slices):
                out.append((s["seq"], list(v)))
                v = [min(s["table"][e][t] + v[e] for e in range(4)) for t in range(4)]
            yield pa.RecordBatch.from_pydict({"seq": pa.array([a for a, _ in out], pa.int64()), "after": pa.array([v for _, v in out], pa.list_(pa.int64()))})


def _exits(batches):
    """The state behind a slice for every state before it."""
    for s in _slices(batches):
        ends = []
        for state in range(4):
            for _, state in walk(s["code"], s["n"], s["after"][0], state):
                pass
            ends.append(state)
        yield pa.RecordBatch.from_pydict({"seq": [s["seq"][0]], "after": pa.array([s["after"][0]], pa.list_(pa.int64())),
                                          "exits": pa.array([ends], pa.list_(pa.int32()))})


def _entries(batches):
    """From a conversation's slices in order: the state before each, and whether it is the last."""
    for batch in batches:
        for slices in batch.column(0).to_pylist():
            state, states = 0, []
            for s in slices:
                states.append(state)
                state = s["exits"][state]
            yield pa.RecordBatch.from_pydict({
                "seq": pa.array([s["seq"] for s in slices], pa.int64()), "after": pa.array([s["after"] for s in slices], pa.list_(pa.int64())),
                "state": pa.array(states, pa.int32()), "ends": [i == len(slices) - 1 for i in range(len(slices))]})


def _in_order(slices: DataFrame, *columns) -> DataFrame:
    """One row per conversation: its slices by place.  At most one a range, so a bounded list."""
    return slices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seq", *columns))).alias("slices")).select("slices")


def _crossing(ranged: DataFrame) -> DataFrame | None:
    """What the search must know of the slices of conversations that span ranges: seq (of the first
    row), after, state, ends.  None if there is none."""
    spans = ranged.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    spans = cut_lineage(spans.select(F.col("conv").alias("conv_")))  # fewer rows than ranges
    if spans.isEmpty():
        return None
    rows = ranged.join(F.broadcast(spans), F.col("conv").eqNullSafe(F.col("conv_"))).select("conv", "part", "seq", "code", "n")
    # a slice's first seq stands for it
    names = cut_lineage(rows.groupBy("conv", "part").agg(F.min("seq").alias("seq")).select("conv", "seq"))

    def named(out):  # at most two slices a range
        return out.join(F.broadcast(names), "seq")

    tables = named(rows.mapInArrow(_tables, "seq long, table array<array<long>>"))
    after = cut_lineage(_in_order(tables, "table").mapInArrow(_after, "seq long, after array<long>"))
    first = rows.join(F.broadcast(after), "seq", "left")
    exits = named(first.mapInArrow(_exits, "seq long, after array<long>, exits array<int>"))
    return cut_lineage(_in_order(exits, "after", "exits").mapInArrow(_entries, "seq long, after array<long>, state int, ends boolean"))


def _edits(keys):
    """Every row with its edits; a slice's last row carries what is known of the whole slice."""
    def run(batches):
        whole = _inserted([0 if s in _ENDS else _FAR for s in range(4)])
        for s in _slices(batches):
            codes, counts, size = s["code"], s["n"], len(s["code"])
            alone = s["after"][0] is None
            before, to, audit, cost, state = [], [], [], 0, 0
            steps = walk(codes, counts, whole if alone else s["after"][0], 0 if alone else s["state"][0])
            letters, state = next(steps)
            for i in range(size):
                audit.append(letters)
                roles, at = [], state
                own = letters.rstrip("D") or "D"
                for _ in range(own.count("I")):
                    roles.append(_ROLE[at])
                    at = _TURNED[at]
                kind = "D" if codes[i] == "x" or own[-1] in "DI" else own[-1]
                before.append(roles)
                to.append({"K": s["role"][i], "R": _ROLE[at]}.get(kind))
                cost += INSERT * len(roles) + DELETE * letters.count("D") + REROLE * (kind == "R")
                cost += TRUNCATED * (kind != "D" and (codes[i].isupper() or codes[i] == "+"))
                letters, state = next(steps)
            closing = _closing(state) if alone or s["ends"][0] else []
            cost += INSERT * len(closing)
            audit.append("I" * len(closing))
            initial = s["initial"]
            illegal = sum(n - 1 for n in counts) + sum(a + b not in _LEGAL for a, b in zip(initial, initial[1:]))
            last = [{"audit": "".join(audit), "cost": cost, "illegal": illegal, "head": initial[0], "tail": initial[-1], "closing": closing}]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[c], t) for c, t in keys] + [pa.array(before, pa.list_(pa.string())), pa.array(to, pa.string()),
                                                        pa.array([None] * (size - 1) + last, _WHOLE_TYPE)],
                names=[c for c, _ in keys] + ["before", "to", "slice"])
    return run


_WHOLE = "struct<audit:string,cost:long,illegal:long,head:string,tail:string,closing:array<string>>"
_WHOLE_TYPE = pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
                         ("closing", pa.list_(pa.string()))])


class Repair:
    """The cheapest edits of every conversation; the search has run when it is made."""

    def __init__(self, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv = conv
        self._rows = _own(conversations, conv, turn, role, text)
        self._ranged = _ranged(_coded(self._rows))
        known = _crossing(self._ranged)
        ranged = self._ranged
        if known is None:
            ranged = ranged.withColumns({"after": F.lit(None).cast("array<long>"), "state": F.lit(None).cast("int"), "ends": F.lit(None).cast("boolean")})
        else:
            ranged = ranged.join(F.broadcast(known), "seq", "left")  # at most two slices a range
        keys = ["conv", "turn", "role", "sha", "part", "seq"]
        arrow = [(f.name, f.type) for f in _arrow_schema(ranged.select(*keys))]
        schema = ", ".join([f"{c} {ranged.schema[c].dataType.simpleString()}" for c in keys] + ["before array<string>", "to string", f"slice {_WHOLE}"])
        self._edits = cut_lineage(ranged.mapInArrow(_edits(arrow), schema))

    def reports(self) -> DataFrame:
        """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost (long), audit."""
        rows, n = self._ranged, F.col("n")
        found = rows.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            F.sum(F.when(F.col("fault") == "blank", n).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", n).otherwise(n - 1)).alias("duplicate"),
            F.count(F.when(F.col("fault") == "truncated", 1)).alias("truncated"))
        # a conversation has at most one slice a range
        slices = self._edits.filter("slice is not null").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seq", "slice"))).alias("s"))
        pairs = F.expr("transform(sequence(1, size(s)), i -> if(i < size(s), concat(s[i - 1].slice.tail, s[i].slice.head), 'su'))")
        bad = F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL)))
        search = slices.select(F.col("conv").alias("conv_"),
                               (F.expr("aggregate(s, 0L, (x, y) -> x + y.slice.illegal)") + bad).cast("long").alias("illegal"),
                               F.expr("aggregate(s, 0L, (x, y) -> x + y.slice.cost)").alias("cost"),
                               F.expr("array_join(transform(s, y -> y.slice.audit), '')").alias("audit"))
        return found.join(search, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_").withColumnRenamed("conv", self.conv)

    def rows(self) -> DataFrame:
        """The repaired rows: conversation, seq and nr (their order), role, text, edit (K, R or I)."""
        def key():
            return F.sha2(F.concat_ws("|", *[F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-")) for c in ("conv", "turn", "role")], F.hex("sha")), 256)

        texts = self._rows.groupBy(key().alias("key")).agg(F.first("text").alias("text"))  # equal keys have equal texts
        kept = self._edits.filter("to is not null").select(key().alias("key"), "conv", "seq", F.size("before").alias("nr"), F.col("to"),
                                                          F.when(F.col("to") == F.col("role"), "K").otherwise("R").alias("edit"))
        kept = kept.join(texts, "key").select("conv", "seq", "nr", F.col("to").alias("role"), "text", "edit")

        def new(roles, shift):
            return self._edits.select("conv", "seq", F.posexplode(roles)).select(
                "conv", "seq", (F.col("pos") + shift).alias("nr"), F.col("col").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))

        out = kept.unionByName(new(F.col("before"), 0)).unionByName(new(F.col("slice.closing"), 1000))
        return out.withColumnRenamed("conv", self.conv)

    def digests(self) -> DataFrame:
        """SHA-256 of each conversation's repaired ``role:text`` lines.  Its chain is sequential, so
        one task reads a conversation's lines in order, without holding them."""
        names = _arrow_schema(self._edits.select("conv")).field(0).type

        def run(batches):
            now, chain, first = None, None, True
            for batch in batches:
                conv, done = batch.column(0).to_pylist(), []
                role, text = batch.column(1), batch.column(2)
                for i, c in enumerate(conv):
                    if chain is None or c != now:
                        if chain is not None:
                            done.append((now, chain.hexdigest()))
                        now, chain, first = c, hashlib.sha256(), True
                    chain.update((("" if first else "\n") + f"{role[i].as_py()}:{text[i].as_py()}").encode())
                    first = False
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], names), pa.array([b for _, b in done], pa.string())], names=["conv", "sha256"])
            if chain is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], names), pa.array([chain.hexdigest()], pa.string())], names=["conv", "sha256"])

        rows = self.rows().withColumnRenamed(self.conv, "conv")
        rows = rows.repartition("conv").sortWithinPartitions("conv", "seq", "nr").select("conv", "role", "text")
        kind = rows.schema["conv"].dataType.simpleString()
        return rows.mapInArrow(run, f"conv {kind}, sha256 string").withColumnRenamed("conv", self.conv)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` after ``damaged``: the report and the hash of the
    repaired rows; a conversation left without rows has zeros and no edits."""
    repair = Repair(damaged(conversations))
    report, hashes = repair.reports(), repair.digests().select(F.col("conv_id").alias("hash_of"), F.col("sha256").alias("repaired_sha256"))
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(report, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id") \
               .join(hashes, F.col("conv").eqNullSafe(F.col("hash_of")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
