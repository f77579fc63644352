"""The pipeline against a plain-Python chain of its decisions, with planted cases."""

import binascii
import random
import zlib

import pytest
from test_documents import base_by_rule, expected_components, expected_spans  # the brute force of the stages

import corpus_pipeline
from wordrate.llm import toxicity
from wordrate.llm.tokens import cuts, encoder

KINDS = ["email", "ip", "card", "phone"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """(documents, labels) with toxic rows, copies, near copies, shared passages and personal data."""
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(3, 7))) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(vocab) for _ in range(n)) + "."
    docs, marks = {}, {}
    for i in range(260):
        words = text(r.choice([30, 60, 120])).split()
        marks[i] = int(i % 4 == 0)
        if marks[i]:
            words[r.randrange(len(words))] = r.choice(["scumbag", "moronic", "idiotish"])
        docs[i] = " ".join(words)
    passage = text(60)
    for i in range(300, 312):
        docs[i] = text(40) + " " + passage + " " + text(40)  # a passage that documents share
    for i in range(320, 326):
        docs[i] = docs[301]  # copies
    for i in range(330, 334):
        docs[i] = docs[305].replace(docs[305].split()[3], f"other{i}", 1)  # near copies
    docs[340] = text(20) + " write to someone.else@mail.example.org or +44 20 7946 0958, host 10.0.0.254 " + text(20)
    docs[341] = "card 4111 1111 1111 1111 " + text(30)
    docs[342] = text(9000)  # longer than a sequence
    docs[350], docs[351], docs[352] = None, "", " \n "
    rows = sorted(docs.items()) + [(None, text(25)), (17, docs[17])]  # no id, and a repeated row
    r.shuffle(rows)
    return rows, marks


def write(spark, folder, rows, marks):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, m) for i, m in marks.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def redacted(text):
    out, at = [], 0
    for a, b, k in base_by_rule(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return text if at == 0 else "".join(out) + text[at:]


def chain(rows, toxic):
    """What should be left after four stages: (doc_id, text)."""
    kept = [(i, t) for i, t in rows if (i, t) not in toxic]
    known = [(i, t) for i, t in kept if i is not None]
    low = {(i, n): c for i, n, c in expected_components(known)}
    gone = {i for (i, _), c in low.items() if c < i}
    kept = [(i, t) for i, t in kept if i not in gone]
    known = [(i, t) for i, t in kept if i is not None]
    cut = {i: raw.decode("utf-8", "ignore") if spans else None for i, _, _, spans, raw in expected_spans(known)}
    kept = [(i, cut[i] if cut.get(i) is not None else t) for i, t in kept]
    return [(i, t if t is None else redacted(t)) for i, t in kept]


def pieces(rows, capacity=2048):
    encode, out = encoder(), []
    for i, t in rows:
        ids = [*encode(t or "").tolist(), 0]
        for k, (a, n) in enumerate(cuts(len(ids), capacity)):
            out.append((i, k, a, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:a + n]))))
    return sorted(map(repr, out))


def test_pipeline_equals_a_plain_chain(spark, tmp_path):
    rows, marks = planted()
    write(spark, str(tmp_path), rows, marks)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    said = toxicity.score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    marked = {x.doc_id for x in said if x.predicted}
    held = {i for i in marks if binascii.crc32(str(i).encode()) % 3 == 1}
    assert sum(marks[i] == (i in marked) for i in held) >= 0.97 * len(held)  # of rows that it did not learn from
    assert not [i for i in marked if i is None or i >= 300]
    expected = chain(rows, {(i, t) for i, t in rows if i in marked})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == pieces(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():  # gapless from 0, at most 2048
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    texts = dict(expected)
    assert len([i for i in range(320, 326) if i in texts]) == 0 and len([i for i in range(330, 334) if i in texts]) == 0
    assert "[EMAIL]" in texts[340] and "[PHONE]" in texts[340] and "[IP]" in texts[340] and texts[341].startswith("card [CARD]")
    assert sum(len(texts[i]) < len(dict(rows)[i]) - 200 for i in range(301, 312)) == 11  # the passage stays in one document


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, None), (2, "")]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """No rows; rows without ids and texts, and repeated ones."""
    write(spark, str(tmp_path), rows, {})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.length == 1 for r in got)
