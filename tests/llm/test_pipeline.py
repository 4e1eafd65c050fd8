"""The corpus pipeline, stage by stage and as a whole, against plain Python on a small corpus with nulls, copies and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sediment.llm import mixing
from sediment.llm.secret_scan import ranked_words, redact_text
from sediment.llm.toxicity import toxicity_scores

from test_jaccard import brute

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.choice([6, 30, 60, 300]))
        if k % 9 == 0:
            words[3:3] = "you stupid idiot you are pathetic trash and scum".split()
        if k % 11 == 1:
            words[2:2] = [f"password=hunter{k}xyz", "|"]
        if k % 13 == 2:
            words.append("mail@example.org")
        rows.append([len(rows), " ".join(words), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"])])
        if k % 8 == 3:  # a near copy
            copy = list(words)
            copy[len(copy) // 2] = "changed"
            rows.append([len(rows), " ".join(copy), "en", "b"])
        if k % 10 == 4:
            rows.append([len(rows), rows[-1][1], "de", None])
    rows += [[1000, None, "en", "a"], [1001, "", "en", "a"], [None, "a text without an id " * 20, None, "c"], [None, "a text without an id " * 20, None, "c"], [5, rows[5][1], "en", "a"]]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("stupid" in r[1])) for r in rows if r[0] is not None and r[1] and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return sorted(rows, key=str)


def keep_one_of_each_group(rows):
    home = {i: c for i, _, c in brute([(r[0], r[1]) for r in rows])}
    out, seen = [r for r in rows if r[0] is None], set()
    for r in rows:
        if r[0] is not None and home[r[0]] == r[0] and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def mixed(rows):
    def topic(t):
        t = t or ""
        return "table" if " | " in t else "contact" if "@" in t or "+1 (" in t else "long" if len(t) >= 4000 else "short" if len(t) < 800 else "prose"

    cell = [(r[3], r[2], topic(r[1])) for r in rows]
    tokens = [len(WORD.findall(r[1] or "")) for r in rows]
    cells = sorted({c for c, n in zip(cell, tokens) if n}, key=str)
    t = np.array([float(sum(n for c, n in zip(cell, tokens) if c == x)) for x in cells])
    total, budget = t.sum(), mixing.BUDGET
    groups = [[[k for k, c in enumerate(cells) if c[d] == v] for v in {c[d] for c in cells}] for d in range(3)]
    shares = []
    for group in groups:
        have = np.array([t[g].sum() for g in group]) / total / budget
        s = np.array([t[g].sum() ** mixing.ALPHA for g in group])
        s = np.minimum(s / s.sum(), have)
        for _ in range(mixing.FILLS):
            full = s >= have
            rest = s[~full].sum()
            s = np.minimum(have, np.where(full, s, s * ((1 - s[full].sum()) / rest if rest > 0 else 1)))
        shares.append(s)
    w, bound = t.copy(), t / (budget * total)
    for sweep in range(mixing.SWEEPS):
        for group, s in zip(groups, shares):
            for g, x in zip(group, s):
                w[g] = np.minimum(bound[g], w[g] * x / w[g].sum())
        if sweep % 3 == 2 and max(abs(w[g].sum() / x - 1) for group, s in zip(groups, shares) for g, x in zip(group, s)) <= 1e-6:
            break
    p = dict(zip(cells, np.minimum(1, budget * total * w / t)))
    draw = lambda i: int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:12], 16) / 16**12
    return [r for r, c in zip(rows, cell) if draw(r[0]) < p.get(c, 0)]


def test_stages_and_run_against_plain_python(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    rows = [tuple(r) for r in docs.collect()]
    score = {(r.doc_id, r.text): r.s for r in toxicity_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"), name="s").collect()}
    want = [r for r in rows if score[r[:2]] < 0.3]
    assert all((score[r[:2]] >= 0.3) == ("stupid" in (r[1] or "")) for r in rows)
    expected = {}
    for name, after in (("toxicity", lambda x: want), ("n-gram Jaccard join", keep_one_of_each_group), ("secret scans", None), ("mixing sources to target weights", mixed)):
        if after is None:
            rank = ranked_words(docs)
            after = lambda x, rank=rank: [(r[0], t := redact_text(r[1], rank=rank), r[2], r[3], r[4] if t is None else len(t), r[5]) for r in x]
        got = stages[name](spark, docs, folder)
        assert got.columns == docs.columns
        rows = after(rows)
        assert key(tuple(r) for r in got.collect()) == key(rows), name
        docs = spark.createDataFrame(rows, docs.schema)
        expected[name] = rows
    assert 0 < len(rows) < len(expected["secret scans"]) and any("[SECRET]" in (r[1] or "") for r in rows)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    for packed in (stages["best-fit packing"](spark, docs, folder), corpus_pipeline.run(spark, folder)):
        out = packed.collect()
        assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == key(pieces)
        bins = {}
        for r in out:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) == -(-sum(p[3] for p in pieces) // 4096)


def test_stages_on_an_empty_table(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_neither_sort_nor_aggregate_texts(spark, folder):
    """Ids that come once: their whole rows only stream. The sorts took more than an executor's memory."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is null or doc_id <> 5")
    out = corpus_pipeline.ngram_jaccard(spark, docs, folder)
    assert out.count() > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and "Aggregate" not in plan, plan


def test_one_row_of_an_id_with_different_texts(spark):
    """Id 3 heads a group with one of its texts and follows id 1 with the other; id 4 only follows."""
    import corpus_pipeline

    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(1, text("a")), (3, text("a")), (3, text("b")), (4, text("b")), (4, text("a")), (6, text("c")), (6, text("c")), (None, text("a")), (None, text("a"))]
    got = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    ids = sorted((r.doc_id for r in got), key=str)
    assert ids == sorted({r[0] for r in rows if r[0] in (1, 3, 6)}) + [None, None] and all(tuple(r) in rows for r in got)


def test_workers_hand_back_memory():
    """What a finished task held in small pieces goes back to the system, though something above it lives on."""
    import subprocess
    import sys

    code = """
import re
from sediment.llm.staging import lean
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
kept = []
def run(batches):
    parts = [bytearray(60_000) for _ in range(3000)]
    kept.append(bytearray(60_000))
    yield held()
before = held()
top = [*lean(run)(iter(()))][0]
print(top - before, held() - before)
"""
    top, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert top > 150 and after < 40


def test_other_operators_drop_a_workers_tokenizer_cache():
    """Tokenizing tasks keep it for each other; it must not weigh on the next operator in the same worker."""
    from sediment.llm import packing
    from sediment.llm.staging import lean

    packing.encoder_of(None, "word_bpe_49k.json")
    assert [*lean(iter, keep=True)([1, 2])] == [1, 2] and packing._encoders
    assert [*lean(iter)([1, 2])] == [1, 2] and not packing._encoders
