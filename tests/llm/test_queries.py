"""Small fixtures against brute force, nulls, ties, empty tables and clashing columns; SQL oracles on the smallest tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import quality_rules, queries, secret_scan
from sediment.llm.ann_search import nearest
from sediment.llm.mixing import keep_probabilities, marginals, mix_documents, rake
from sediment.llm.packing import best_fit, fill_sequences, pack_pieces, tokenize_pieces
from sediment.llm.quality_crf import LineField, quality_scores
from sediment.llm.quality_rules import quality_cascade
from sediment.llm.secret_scan import find_spans, guess_bits, ranked_words, redact_secrets, redact_text, scan_secrets
from sediment.llm.toxicity import LabelModel, toxicity_scores
from sediment.llm.url_filter import filter_urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, score double"
ODD = [(1, None, None, None, None, 1, 0.0), (2, "", "en", "s", 0, 1, 0.0), (2, "", "en", "s", 0, 1, 0.0), (None, "a b c", "en", None, 5, 0, 0.0), (5, "wort " * 9000, "de", "s", 45000, 0, 0.0)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = con.execute(f"select {', '.join(want.columns)} from '{tmp_path}/out/*.parquet'").df()
    by = list(want.columns)
    assert got.sort_values(by).astype(str).values.tolist() == want.sort_values(by).astype(str).values.tolist()


def test_urls(spark):
    rows = [(1, "https://A.Example.org/es/x?q"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/"), (4, "x"), (5, None), (6, "http://casino.net"), (6, "http://casino.net"), (7, "http://shop.com/de/1"), (8, "http://x.org"), (None, "ftp://my-poker.biz#a")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: (r._host, r._path, r._rule, r._verdict) for r in filter_urls(pages).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("notexample.org", "/es/", "org/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("casino.net", "", None, "block"), 7: ("shop.com", "/de/1", "com/de/", "block"), 8: ("x.org", "", None, "allow"), None: ("my-poker.biz", "", None, "block"),
    }
    assert filter_urls(pages.limit(0)).count() == 0


def test_url_lists_as_tables(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.x{k % 7}.com/a/{k}", "r", "v") for k in range(400)], "page_id long, url string, _rule string, _verdict string")
    rules = spark.createDataFrame([("block", f"x{k}.com", "/a/") for k in range(3)] + [("allow", f"h{k}.x{k % 7}.com", f"/a/{k}") for k in range(0, 400, 9)], "action string, host string, path string")
    hosts = spark.createDataFrame([("x5.com",), ("h4.x4.com",), ("h4.x4.com",), ("elsewhere.org",)], "host string")
    got = {r.page_id: (r._rule, r._verdict) for r in filter_urls(pages, rules=rules, blocked_hosts=hosts).collect()}
    for k in range(400):
        rule = f"h{k}.x{k % 7}.com/a/{k}" if k % 9 == 0 else f"x{k % 7}.com/a/" if k % 7 < 3 else None
        bad = k % 9 and (k % 7 < 3 or k % 7 == 5 or k == 4)
        assert got[k] == (rule, "block" if bad else "allow"), k
    assert {r._verdict for r in filter_urls(pages, rules=[], blocked_hosts=hosts.limit(0)).collect()} == {"allow"}


def test_secret_spans():
    text = 'pässword: "abc" Password = hunter2x! token=short secret:token = abcdefgh AKIA' + "A" * 16 + " " + "0f" * 12
    kinds = [(a, k, text[a:b]) for a, k, b, _ in find_spans(text)]
    assert [k for _, k, _ in kinds] == [0, 1, 2] and kinds[0][2] == "Password = hunter2x"
    assert [text for text in (redact_text("a password=secret99 b"),)] == ["a [SECRET] b"]
    found = find_spans("the passphrase is tr0ub4dor&3xQz91 ok; passphrase is password123")
    assert [k for _, k, _, _ in found] == [3]


@pytest.mark.parametrize("head", ["password=", "userPassword=", "DB_PWD=", "secret_key=", "AWS_SECRET_ACCESS_KEY=", "my_passphrase: "])
def test_secret_tails_and_identifiers(head):
    clean = redact_text(f"a {head}Tr0ub4dor&3xQz91! b")
    assert "Tr0ub4dor" not in clean and "3xQz91" not in clean and clean.startswith("a ") and clean.endswith(" b")


def test_quoted_secrets_end_at_their_quote():
    assert redact_text('{"password":"Tr0ub4dor&3xQz91","user":"bob"}') == '{"[SECRET]","user":"bob"}'
    assert redact_text('{"password":"hunter22","user":"bob"}') == '{"[SECRET]","user":"bob"}'
    assert redact_text("the compass is northeastward") == "the compass is northeastward"


def test_guess_cost_is_a_minimum():
    assert guess_bits("") == 0
    assert guess_bits("password") < 12 < guess_bits("pqsswzrd")
    assert guess_bits("aaaaaaaaaaaa") < 14 and guess_bits("qwertyuiop") < 14
    assert guess_bits("1987-05-21") < 20 < guess_bits("7402958163")
    x = "zQ8#kfm2"
    assert math.isclose(guess_bits(x + "password"), guess_bits(x) + guess_bits("password"), rel_tol=0.2)
    assert guess_bits("k7" * 50_000) > 1000


def brute_guess_bits(value, rank):
    """The least cost over all segmentations, by trying every stretch as every kind of segment."""
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            part, costs = value[i:j], [secret_scan.PART + sum(map(secret_scan._brute_bits, value[i:j])), secret_scan.word_bits(value[i:j], rank) if 3 <= j - i <= secret_scan.LONGEST else math.inf]
            if secret_scan.DATE.fullmatch(part):
                costs.append(secret_scan.date_bits(j - i))
            if j - i >= 3 and len(set(low[i:j])) == 1:
                costs.append(secret_scan.repeat_bits(value[i], j - i))
            ways = [secret_scan._walk_step(low, k) for k in range(i + 1, j)]
            if j - i >= 3 and all(ways):
                turns = sum(a != b for a, b in zip(ways, ways[1:]))
                costs.append(secret_scan.PART + secret_scan.FIRST_KEY + secret_scan.STEP * (j - i - 1) + secret_scan.TURN * turns)
            best[j] = min(best[j], best[i] + min(costs))
    return best[n]


def test_guess_cost_against_every_segmentation():
    rng = np.random.default_rng(8)
    parts = ["password", "the", "Dragon", "p@ssw0rd", "aaaa", "zzz", "qwert", "asdfdsa", "poiu", "1987-05-21", "2019", "31121999", "k7", "X", "9", "#", "were", "3333333", "wewewe", "SECRET"]
    values = ["".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(1200)] + ["".join(rng.choice(list("aAqwerty123!"), rng.integers(0, 14))) for _ in range(800)] + ["k7aaaaafterthan", "aaa", "a" * 40 + "password"]
    rank = {w: k + 1 for k, w in enumerate(["the", "after", "than", "password", "dragon", "were", "secret", "art", "was"])}
    for value in values:
        assert math.isclose(guess_bits(value, rank), brute_guess_bits(value, rank), rel_tol=1e-9, abs_tol=1e-9), value


def test_spaces_before_a_credential_value():
    assert redact_text("the passphrase is" + " " * 9 + "tr0ub4dor&3xQz91 ok") == "the passphrase is" + " " * 9 + "[SECRET] ok"


def test_dictionary_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "Zebrafish zebrafish, quokka QUOKKA quokka"), (2, None), (3, "once")], "doc_id long, text string")
    rank = ranked_words(docs)
    assert rank["quokka"] < rank["zebrafish"] and "once" not in rank and rank["the"] == 1
    assert guess_bits("quokkazebrafish", rank) < guess_bits("quokkazebrafish")


def test_secrets_and_rules_on_odd_rows(spark, odd):
    assert sorted(r.doc_id or 0 for r in scan_secrets(odd).collect()) == [0, 1, 2, 2, 5]
    leak = odd.withColumn("text", F.when(F.col("doc_id") == 5, "a password=secret99 b").otherwise(F.col("text")))
    clean = {r.doc_id: (r.text, r.n_chars) for r in redact_secrets(leak).collect()}
    assert clean == {1: (None, None), 2: ("", 0), None: ("a b c", 5), 5: ("a [SECRET] b", 12)} and redact_secrets(leak).columns == odd.columns
    got = {r.doc_id: r for r in quality_cascade(odd.select("doc_id", "text")).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[2].kept
    assert got[5].n_words == 9000 and got[5].n_repeat_words == 9000
    assert quality_cascade(odd.limit(0).select("doc_id", "text")).count() == 0


def test_every_rule_rejects_and_the_order_changes_nothing(spark):
    prose = " ".join(f"word{k}s of tale" for k in range(40))
    texts = {"symbols": prose + " #" * 90, "repeated_lines": "\n".join(["one line that comes again"] * 4 + [prose]), "word_length": " ".join(f"{k}" * 26 for k in "abcdefghijkl"), "capitals": prose.upper(), "exclamation": prose.replace(" tale", "! tale"),
             "digits": " ".join(f"{k * 7919 + 10**9}" for k in range(30)), "bullets": "\n".join(f"- item{k} is a{k} thing" for k in range(12)), "one_word": "x " * 400, None: prose}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rules = quality_rules.default_rules()
    kept = []
    for order in (rules, rules[::-1]):
        got = {r.doc_id: r for r in quality_cascade(docs, order).collect()}
        kept.append({k: r.kept for k, r in got.items()})
        for k, name in enumerate(texts):
            assert got[k].kept == (name is None), name
    assert kept[0] == kept[1]
    stats = quality_rules.with_statistics(docs)
    for k, name in enumerate(list(texts)[:-1]):
        assert stats.filter(dict(rules)[name]).filter(F.col("doc_id") == k).count() == 1, name
    measured = quality_rules.measure_rules(stats, rules)
    assert [m["rule"] for m in measured] == [n for n, _ in rules] and all(0 <= m["rejection"] <= 1 and m["cost"] > 0 for m in measured)


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (4, 5, 6, 9, 12, 30, 80)] + ["x y z\n\nx y z\n \nX\n|#| end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_cascade(docs).collect():
        words, seen = texts[r.doc_id].split(), {}
        for k in range(len(words) - 4):
            seen.setdefault(tuple(words[k : k + 5]), []).append(k)
        assert r.n_repeat_words == len({j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 5)})
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
    assert (r.n_dup_lines, r.n_symbols) == (1, 3)


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 64, 400))[::-1]
    for rule in ("norm", "dot"):
        bins, offsets = best_fit(sizes, 64, 5, 3969.0, (1.0, 0.1, 0.1), rule)
        for b in np.unique(bins):
            mine = sizes[bins == b]
            assert mine.sum() <= 64 and len(mine) <= 5 and (mine.astype(float) ** 2).sum() <= 3969
            assert sorted(offsets[bins == b]) == list(np.cumsum(np.append(0, mine[np.argsort(offsets[bins == b])]))[:-1])


def test_packing_weighs_every_residual():
    """The query's weights choose other bins than tokens alone would, under the query's own capacities too; and each capacity binds."""
    sizes = np.sort(np.random.default_rng(7).integers(1, 3000, 600))[::-1]
    tokens_only, _ = best_fit(sizes, 4096, 4096, 4096.0**2, (1.0, 0.0, 0.0), "norm")
    weighed, _ = best_fit(sizes, 4096, 4096, 4096.0**2, (1.0, 0.3, 0.3), "norm")
    assert tokens_only.tolist() != weighed.tolist() and abs(int(tokens_only.max()) - int(weighed.max())) <= 1
    narrow, _ = best_fit(np.full(6, 10), 100, 2, 1e4, (1.0, 0.1, 0.1), "norm")
    assert np.bincount(narrow).tolist() == [2, 2, 2]
    dear, _ = best_fit(np.array([50, 40, 10]), 100, 9, 3000.0, (1.0, 0.1, 0.1), "norm")
    assert dear[0] != dear[1] and len(set(dear)) == 2


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sediment.llm.packing import encoder_of

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a.b,c--d's it's 'll I'LL", "Ünïcödé İstanbul ŉa ǆ ß ſ ﬁ", "e\u0301 é<|endoftext|>x <|end", "x&&&'s x&&& x&&&'", "a_b __ 12ab3 ab12", "naïve x\u00a0y\u3000z\x0b\x0c\x1c\x85q", "ªº µ ﬀ", "日本語 한국어", "", " \n", "z" * 300 + ".", "Ha-Ha ha! HA? (ha) [ha] 'tis"]
    real = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = encoder_of(None, "word_bpe_49k.json").encode([*odd, *real])
    for text, ids in zip([*odd, *real], got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    pieces = tokenize_pieces(odd, max_tokens=64, keep_ids=True).cache()
    placed = pack_pieces(pieces.drop("ids"), max_tokens=64)
    full = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in fill_sequences(pieces.filter("doc_id is not null"), placed).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] or "" for r in ODD}
    rows = placed.collect()
    for doc_id in (1, 5):
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = np.concatenate([full[r.sequence_id][r.offset : r.offset + r.length] for r in mine])
        assert ids.tolist() == tok.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) for r in mine)
    assert pack_pieces(tokenize_pieces(odd.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 12)).astype("float32")
    x[700:1200] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd_rows = [(5001, None), (5002, [0.0] * 12), (5003, [float("nan")] + [1.0] * 11), (5004, [None] + [1.0] * 11), (5005, [1.0]), (None, [1.0] * 12), (0, rows[0][1])]
    vectors = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s[m[1]] - m[2]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
    assert hits >= 0.9 * 20 * 75
    few = spark.createDataFrame(rows[:7], "vec_id long, embedding array<float>")
    assert nearest(few, few.filter("vec_id = 0")).count() == 6
    assert nearest(few.limit(0), few.limit(0)).count() == 0


def recall(spark, x, asked, k=20):
    """Share of the true k nearest rows that `nearest` finds, by query."""
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(vectors, vectors.filter(F.col("vec_id").isin(asked)), k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    out = []
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        out.append(len(found[q] & set(np.argsort(-s)[:k].tolist())) / k)
    return np.array(out)


def test_neighbours_beside_a_cluster_of_near_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.6 * rng.standard_normal((6000, 32))
    x[:2000] = x[0] + 0.02 * rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = list(range(0, 6000, 50))
    got = recall(spark, x, asked)
    assert got[:40].mean() >= 0.9 and got[40:].mean() >= 0.9


def test_neighbours_in_one_part(spark):
    x = np.random.default_rng(13).standard_normal((1500, 12))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = recall(spark, x, list(range(0, 1500, 50)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert got.mean() >= 0.9


def test_line_field_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    field = LineField(3)
    field.w, field.pair, field.start = rng.standard_normal(3), rng.standard_normal((2, 2)), rng.standard_normal(2)
    counts = np.array([4, 1, 3])
    starts = np.cumsum(counts) - counts
    x = rng.standard_normal((8, 3))
    bad, _, _ = field.marginals(x, starts, counts)
    for s, n in zip(starts, counts):
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            score = field.start[y[0]] + sum(x[s + k] @ field.w for k in range(n) if y[k]) + sum(field.pair[y[k - 1], y[k]] for k in range(1, n))
            total += math.exp(score)
            on += math.exp(score) * np.array(y)
        assert np.allclose(bad[s : s + n], on / total)


@pytest.mark.parametrize("name,label,folds,held,caught,spared", [("op8_line_crf_quality", "quality", 5, 0, 0.93, 0.85), ("op10_weak_supervision_toxicity", "toxic", 4, 2, 0.85, 0.97)])
def test_held_out_recall(spark, name, label, folds, held, caught, spared):
    """Shares of held-out rows with label 1 that are found, and with label 0 that are left alone; always one answer fails one of them."""
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    on, off = ([r.predicted for r in got if r.held_out and r[label] == x] for x in (1, 0))
    assert sum(on) >= caught * len(on) and len(off) - sum(off) >= spared * len(off)


def test_label_model_learns_accuracies_and_dependence():
    """Votes drawn from a known model, a third of the rows with a gold label that is wrong now and then, one voter a copy of another."""
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.2
    rates = [(0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.5, 0.2)]
    votes = np.stack([np.where(truth, rng.random(6000) < a, rng.random(6000) < b) for a, b in rates], 1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], 1)
    gold = np.where(rng.random(6000) < 0.33, np.where(rng.random(6000) < 0.05, ~truth, truth).astype(float), np.nan)
    model = LabelModel().fit(votes, gold)
    assert abs(model.prior - truth.mean()) < 0.03 and abs(model.gold_accuracy - 0.95) < 0.03
    for k, (a, b) in enumerate(rates):
        assert abs(model.accuracy[k] - (truth * a + ~truth * (1 - b)).mean()) < 0.03
    assert model.parents[4] == 0 or model.parents[0] == 4
    unknown = np.isnan(gold)
    assert ((model.posterior > 0.5) == truth)[unknown].mean() > 0.93
    alone = LabelModel().fit(votes, np.full(6000, np.nan))
    assert ((alone.posterior > 0.5) == truth).mean() > 0.9


def test_toxicity_without_labels(spark):
    """The fixed voters alone teach the classifier."""
    rng = np.random.default_rng(5)
    calm = [" ".join(rng.choice([f"w{k}" for k in range(300)], 40)) for _ in range(200)]
    rude = [c + " you stupid idiot, you are scum and trash" for c in calm[:40]]
    docs = spark.createDataFrame(list(enumerate(rude + calm[40:])), "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels)
    assert got.columns == ["doc_id", "text", "score"]
    assert all((r.score >= 0.3) == (r.doc_id < 40) for r in got.collect())


def test_classifiers_on_odd_rows(spark, odd):
    docs = odd
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality_scores, toxicity_scores):
        assert f(docs, labels).count() == 5 and f(docs.limit(0), labels).count() == 0
        assert all(0 <= r.score <= 1 for r in f(docs, labels.limit(0)).collect())


def test_raking_meets_targets(spark, odd):
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", float(1 + (a * 7 + b * 3 + c) % 11)) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, tokens double")
    rows = rake(cells, alpha=0.5, budget=0.2, sweeps=24, tolerance=1e-7).toPandas()
    for d in ("source", "lang", "topic"):
        want = cells.groupBy(d).agg(F.sqrt(F.sum("tokens")).alias("w")).toPandas().set_index(d).w
        assert np.allclose(rows.groupby(d).weight.sum().sort_index(), (want / want.sum()).sort_index(), atol=1e-6)
    kept = mix_documents(odd, budget=1.0)
    assert {r.doc_id for r in kept.collect()} == {None, 5} and mix_documents(odd.limit(0)).count() == 0


def test_bounded_raking_hands_on_what_cells_cannot_give(spark):
    """Expected tokens of the draw meet the feasible targets although some cells give all they have."""
    rng = np.random.default_rng(2)
    table = [(f"s{a}", f"l{b}", f"t{c}", float(rng.integers(1, 200) * (50 if a == 0 else 1))) for a in range(5) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(table, "source string, lang string, topic string, tokens double")
    targets = {"topic": spark.createDataFrame([("t0", 0.7), ("t1", 0.2), ("t2", 0.1)], "value string, share double")}
    raked = rake(cells, targets=targets, budget=0.5, sweeps=30, tolerance=1e-4)
    p = keep_probabilities(raked, 0.5).toPandas()
    total = p.tokens.sum()
    assert (p.p <= 1).all() and (p.p > 1 - 1e-9).any()
    report = marginals(raked, targets=targets, budget=0.5).toPandas()
    assert (report.wanted > report.feasible + 1e-9).any() and np.allclose(report.groupby("dimension").feasible.sum(), 1)
    for d in ("source", "lang", "topic"):
        drawn = (p.tokens * p.p).groupby(p[d]).sum() / (0.5 * total)
        want = report[report.dimension == d].set_index("value").feasible
        assert np.allclose(drawn.sort_index(), want.sort_index(), rtol=0.05)  # what each can give, not all can give together


def test_base_digest(spark):
    rows = queries.QUERIES["op2_guess_cost_secrets"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, rank = {r.doc_id: r.text for r in docs.collect()}, ranked_words(docs)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in rows:
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert set(r.spans.split(",")) - {""} >= {f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans}
        assert r.spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in find_spans(t or "", rank=rank))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
