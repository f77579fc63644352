"""Token-probability scoring as Column expressions.

The step-1 alternatives are an ``array<struct<token, logprob>>`` column; scoring folds
over that short array with ``aggregate`` -- no explode, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ascii_digits, int_token


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expected_rating(alternatives, token_field: str = "token", logprob_field: str = "logprob") -> Column:
    """X11: sum(v * e^lp) / sum(e^lp) over alternatives whose token is an integer.

    Alternatives that are not integers are skipped; with no integer alternative the
    result is 0.0 (the sum divided by 1).  NULL when the array itself is NULL.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"))

    def step(acc, t):
        v = int_token(t[token_field])
        w = F.exp(t[logprob_field].cast("double"))
        ok = v.isNotNull() & t[logprob_field].isNotNull()
        return F.struct(
            F.when(ok, acc["s"] + v.cast("double") * w).otherwise(acc["s"]).alias("s"),
            F.when(ok, acc["p"] + w).otherwise(acc["p"]).alias("p"),
        )

    def finish(acc):
        return acc["s"] / F.when(acc["p"] > 0, acc["p"]).otherwise(F.lit(1.0))

    return F.aggregate(_col(alternatives), zero, step, finish)


def numeric_alternatives(alternatives, token_field: str = "token") -> Column:
    """the alternatives whose token reads as an integer."""
    return F.filter(_col(alternatives), lambda t: int_token(t[token_field]).isNotNull())


def live_expected_rating(alternatives, token_field: str = "token", logprob_field: str = "logprob") -> Column:
    """X11 without a gate; zero weighted value or no probability mass -> NULL."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"))

    def step(acc, t):
        v = int_token(t[token_field])
        w = F.exp(t[logprob_field].cast("double"))
        ok = v.isNotNull() & t[logprob_field].isNotNull()
        return F.struct(
            F.when(ok, acc["s"] + v.cast("double") * w).otherwise(acc["s"]).alias("s"),
            F.when(ok, acc["p"] + w).otherwise(acc["p"]).alias("p"),
        )

    def finish(acc):
        return F.when((acc["s"] != 0) & (acc["p"] != 0), acc["s"] / acc["p"])

    return F.aggregate(_col(alternatives), zero, step, finish)


def one_token(steps) -> Column:
    """X12 gate A: the answer is exactly one generated token."""
    return F.coalesce(F.size(_col(steps)) == 1, F.lit(False))


def integer_answer(text) -> Column:
    """X13 gate B: ``str(x).isdigit() and int(x) < 1000``."""
    t = _col(text)
    return F.coalesce(t.rlike("(?U)^\\d+$") & (ascii_digits(t).try_cast("bigint") < 1000), F.lit(False))


def gated(gate: Column, value: Column) -> Column:
    """Keep a value only where the gate holds."""
    return F.when(gate, value)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body`` (lambda variables are not
    recomputed, while a plain sub-expression inside a higher-order function would be
    re-evaluated for every array element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax_topk(scores, k: int = 5) -> Column:
    """X17 + T7: raw vocabulary scores of one step -> top-k ``struct<index, logprob>``.

    log-softmax via log-sum-exp, then the k largest in descending order (ties by the
    lower index).  The first entry is the arg-max token.  The normaliser is computed
    once per step.  One pass keeps the k best seen so far; a score is put among them only if it
    beats the last, so the cost is linear in the vocabulary and nothing of its size is sorted
    or built.
    """
    v = _col(scores)
    best = "array<struct<neg:double,index:int>>"

    def with_lse(lse):
        def step(kept, x):
            new = F.struct((lse - x.cast("double")).alias("neg"), kept["at"].alias("index"))
            better = (F.size(kept["best"]) < k) | (new < F.element_at(kept["best"], -1))
            best_now = F.when(better, F.slice(F.array_sort(F.array_append(kept["best"], new)), 1, k)).otherwise(kept["best"])
            return F.struct((kept["at"] + 1).alias("at"), best_now.alias("best"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(best).alias("best"))
        top = F.aggregate(v, start, step, lambda kept: kept["best"])
        return F.transform(top, lambda s: F.struct(s["index"].alias("index"), (F.lit(0.0) - s["neg"]).alias("logprob")))

    def with_max(m):
        lse = m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - m)))
        return _let(lse, with_lse)

    return _let(F.array_max(v).cast("double"), with_max)


def token_bytes(token) -> Column:
    """UTF-8 byte values of a token as ``array<int>`` (linear in the text length).

    The UTF-8 bytes are re-read as ISO-8859-1, where every byte is one character whose
    code point equals the byte value; splitting into characters then gives the values."""
    raw = F.encode(_col(token), "UTF-8")
    latin = F.decode(raw, "ISO-8859-1")
    return (F.when(F.octet_length(raw) > 0, F.transform(F.split(latin, ""), lambda c: F.ascii(c)))
             .when(raw.isNotNull(), F.array().cast("array<int>")))
