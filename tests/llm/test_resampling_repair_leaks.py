"""Importance resampling, conversation repair and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordrate.llm import byte_words, conversation_repair, decontamination, importance

# extra columns whose names the operators use inside
SCHEMA = ("doc_id long, text string, lang string, n_words long, rank long, items array<string>, spans long, _text string, "
          "own_0 long, _digest string, n long, score double")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 8, ["z"], 9, "t", 11, "d", 12, 0.5) for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode().lower())


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß9") for _ in range(r.randint(1, 5))) for _ in range(60)] + ["x" * 70, "é" * 90, "AB"]
    def text(k):
        return "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-", "__", " \t", "\x00"]) for _ in range(k))
    out = [(0, None), (1, ""), (2, " ,.\n"), (3, "One"), (4, "one two"), (5, "x" * 3000)]
    out += [(i, text(r.choice([1, 2, 5, 9, 10, 11, 25, 60]))) for i in range(6, n)]
    out += [(7, out[7][1]), (8, out[9][1]), (None, text(30)), (n, text(4000))]  # a repeated row, an id with two texts, no id, a long one
    return out


# --- words and checksums -------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB3é .,zZ-\x00", max_size=90), min_size=1, max_size=8))
def test_words_and_checksums(texts):
    raws = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raws])
    raw = byte_words.lowered(np.frombuffer(b"".join(raws), np.uint8))
    starts, ends, text = byte_words.word_bounds(raw, off)
    expected = [WORD.findall(x.lower()) for x in raws]
    got = [[] for _ in raws]
    for a, b, k in zip(starts, ends, text):
        got[k].append(raw[a:b].tobytes())
    assert got == expected
    where, crc = byte_words.run_crcs(raw, starts, ends, text, 3)
    runs = Counter((k, zlib.crc32(b" ".join(w[i:i + n]))) for k, w in enumerate(expected) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert Counter(zip(where.tolist(), crc.tolist())) == runs
    hashes = byte_words.word_hashes(raw, starts, ends)
    by_word = {}
    for a, b, h in zip(starts, ends, hashes.tolist()):
        assert by_word.setdefault(raw[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- importance resampling -----------------------------------------------------------------

def features(text):
    w = words(text)
    return [b" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected_ranks(docs, target, parts=5, of=100, buckets=10000):
    def counts(rows):
        return Counter(zlib.crc32(f) % buckets for _, t in rows for f in features(t))

    s, t = counts(docs), counts(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + buckets)) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0], r[2], r[3]))
    for place, r in enumerate(able[:parts * len(able) // of], 1):
        r[5] = place
    return sorted(map(repr, rows))


@pytest.mark.parametrize("parts", [5, 60])
def test_importance_ranks(spark, parts):
    docs, target = corpus(1), corpus(2, 20)
    got = importance.importance_ranks(frame(spark, docs), frame(spark, target), parts=parts)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(repr(list(r)) for r in got.collect()) == expected_ranks(docs, target, parts)


def test_importance_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, corpus(3, 10))
    assert importance.importance_ranks(none, some).count() == 0
    got = importance.importance_ranks(some, none).collect()
    assert sorted(repr(list(r)) for r in got) == expected_ranks(corpus(3, 10), [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=70, max_size=70), min_size=1, max_size=5), st.lists(st.integers(-40000, 40000), min_size=70, max_size=70))
def test_planes_give_the_exact_sum(counts, gain):
    planes, value = importance.gain_planes(np.array(gain))
    assert importance.weights(np.array(counts), planes, value).tolist() == [sum(c * g for c, g in zip(row, gain)) for row in counts]


# --- decontamination -----------------------------------------------------------------------

def benchmark(docs, seed=4):
    r = random.Random(seed)
    texts = [t for _, t in docs if len(words(t)) >= 25]
    items = []
    for i in range(12):
        w = [x.decode() for x in words(r.choice(texts))]
        a = r.randrange(len(w) - 15)
        items.append((i, " ".join(w[a:a + r.choice([10, 12, 15])])))
    items += [(12, "one"), (13, "ONE; two"), (14, None), (15, " . "), (3, "ab"), (None, " ".join(x.decode() for x in words(texts[0])[:11])), (16, "absent words"),
              (0, items[0][1])]
    return items


def expected_hits(docs, items, length=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), length)
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j:j + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("set_bytes", [decontamination.SET_BYTES, 0])
def test_contamination(spark, set_bytes):
    docs = corpus(5, 80)
    items = benchmark(docs)
    rows = decontamination.contamination(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"), set_bytes=set_bytes).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in rows) == expected_hits(docs, items)
    assert sum(r.n_hit > 0 for r in rows) > 5
    by_text = {}
    for i, t in docs:
        by_text.setdefault(i, []).append((t or "").encode())
    for r in rows:  # the spans hold the hit words and no other
        inside = [sum(len(WORD.findall(raw.lower()[s.start:s.end])) for s in r.spans) for raw in by_text[r.doc_id]]
        assert r.n_hit in inside


@pytest.mark.parametrize("set_bytes", [decontamination.SET_BYTES, 0])
def test_decontaminated_texts(spark, set_bytes):
    docs = corpus(6, 50)
    items = frame(spark, benchmark(docs)).withColumnRenamed("doc_id", "item_id")
    found = {(r.doc_id, r.n_words): r for r in decontamination.contamination(frame(spark, docs), items).collect()}
    cut = decontamination.decontaminated(frame(spark, docs), items, set_bytes=set_bytes)
    assert cut.columns == frame(spark, docs).columns
    expected = []
    for i, t in docs:
        raw = None if t is None else t.encode()
        for s in reversed(found[(i, len(words(t)))].spans):
            raw = raw[:s.start] + raw[s.end:]
        expected.append((i, None if raw is None else raw.decode()))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in cut.collect()))) == sorted(map(repr, expected))
    assert {r.own_0 for r in cut.collect()} == {11}
    left = decontamination.decontaminated(frame(spark, docs), items, remove="documents", set_bytes=set_bytes)
    assert sorted(repr((r.doc_id, r.text)) for r in left.collect()) == sorted(repr((i, t)) for i, t in docs if found[(i, len(words(t)))].n_hit == 0)
    with pytest.raises(ValueError):
        decontamination.decontaminated(frame(spark, docs), items, remove="some")


def test_contamination_of_empty_tables(spark):
    docs = corpus(7, 10)
    none = frame(spark, []).withColumnRenamed("doc_id", "item_id")
    assert all(r.n_hit == 0 and r.spans == [] for r in decontamination.contamination(frame(spark, docs), none).collect())
    assert decontamination.contamination(frame(spark, []), frame(spark, docs).withColumnRenamed("doc_id", "item_id")).count() == 0


# --- conversation repair -------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, conv string, n long, code string, seq long"
TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def best_edits(rows):
    """(cost, letters, repaired lines) of (role, text, fault) rows, by trying every edit."""
    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if inserted < 2:
            role, to = TURN[state]
            c, a, t = best(i, to, inserted + 1)
            options.append((c + 5, "I" + a, (role + ":",) + t))
        if i == len(rows):
            return min(options + ([(0, "", ())] if state in (0, 3) else []), default=(10**9, "", ()))
        role, text, fault = rows[i]
        c, a, t = best(i + 1, state, 0)
        options.append((c + 2, "D" + a, t))
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
            if to:
                c, a, t = best(i + 1, to, 0)
                options.append((c + more, "K" + a, (f"{role}:{text}",) + t))
            role, to = TURN[state]
            c, a, t = best(i + 1, to, 0)
            options.append((c + more + 1, "R" + a, (f"{role}:{text}",) + t))
        return min(options)
    return best(0, 0, 0)


def expected_report(rows):
    kept = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        kept[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, facts = set(), []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            facts.append((role, text, fault))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = Counter(f for *_, f in facts)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit, lines = best_edits(tuple(facts))
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = [(1, None, None, None), (1, None, "user", "a."), (2, 0, "user", "\x0b\t"), (3, 5, "", "z."), (None, 1, "user", "q?"), (None, 2, "assistant", "r")]
    for c in range(10, 10 + n):
        for turn in range(r.choice([0, 1, 2, 4, 7, 12])):
            t = r.choice([turn] * 6 + [turn + 3, None])
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "user", "system", "tool", None]),
                         r.choice(["a.", "b!", "c", "c ", "", None, f"t{r.random()}.", f"u{r.random()}", "é. "])))
    rows += rows[10:20]  # repeated rows
    for turn in range(300):  # one conversation with most rows
        rows.append((7, turn if r.random() < 0.9 else None, r.choice(["user", "assistant", "system"]), r.choice(["ok.", "no", f"{turn}.", f"{turn}"])))
    r.shuffle(rows)
    return rows


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y", 4) for r in rows], CONV)


@pytest.mark.parametrize("ranges", ["1", "4", "23"])
def test_repair_report(spark, ranges):
    """One slice, several, and a conversation over most of the ranges."""
    rows = conversations(int(ranges))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = conversation_repair.repair_report(talk(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(repr(tuple(r)) for r in got) == expected_report(rows)


def test_repaired_rows_are_legal(spark):
    rows = conversations(9, 20)
    repair = conversation_repair.Repair(talk(spark, rows))
    roles = {}
    for r in sorted(repair.rows().collect(), key=lambda r: (r.seq, r.nr)):
        roles.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values()) and len(roles) > 5


def test_repair_of_an_empty_table(spark):
    assert conversation_repair.repair_report(talk(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-SUA+x"), st.integers(1, 3)), max_size=14), st.integers(0, 13))
def test_slices_give_what_the_whole_gives(rows, cut):
    codes, counts = [c for c, _ in rows], [n for _, n in rows]
    end = conversation_repair._inserted([0, 1 << 60, 1 << 60, 0])
    whole = list(conversation_repair.walk(codes, counts, end, 0))
    after = conversation_repair.costs(codes[cut:], counts[cut:], end)
    head = list(conversation_repair.walk(codes[:cut], counts[:cut], after, 0))
    tail = list(conversation_repair.walk(codes[cut:], counts[cut:], end, head[-1][1]))
    assert head[:-1] + tail == whole
