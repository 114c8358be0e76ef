"""Each operator on small tables: against brute force, and in odd cases (nulls, empty and very long texts, ties, repeated rows,
empty tables, other columns with clashing names)."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lwwspark.llm import chat, embed_dedup, language, mixing, pieces, quality, simhash, token_scan, top_k, url_rules
from lwwspark.operators import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "a b c d"), (4, "a b c d"), (5, LONG), (6, "12 34"), (None, "no id here"), (7, "é😀 ünï\u2581 x"), (8, "A\x00b\x0bc")]


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("clash") for c in ("score", "fp", "x", "id", "order", "fingerprint", "component_id", "rate", "copies", "words", "p0", "n_words", "ids", "key", "node")})


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def broadcast_rows(spark, after):
    """Rows of each broadcast in the queries numbered above ``after``, and the highest number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, found, last = spark._jsparkSession.sharedState().statusStore(), [], after
    runs = store.executionsList()
    for number in [runs.apply(i).executionId() for i in range(runs.size())]:
        last = max(last, number)
        if number <= after:
            continue
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in [nodes.apply(i) for i in range(nodes.size())]:
            for m in [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return found, last


# chat


def render_log(spark, rows, **more):
    schema = "conv_id long, seq long, kind string, message string, role string, text string"
    out = chat.format_conversations(spark.createDataFrame(rows, schema), seq="seq", kind="kind", message="message", **more)
    found = {}
    for r in out.collect():
        found.setdefault(r.conv_id, []).append(r)
    return {k: [t for r in v for t in chat.parse(r.formatted)] for k, v in found.items()}, found


def test_events_are_folded(spark):
    turns, _ = render_log(
        spark,
        [
            (1, 1, "message", "u", "user", "hi"), (1, 2, "message", "a", "assistant", "He"), (1, 3, "delta", None, "assistant", "llo"),
            (1, 4, "message", "u2", "user", "more"), (1, 5, "edit", "u", "user", "hey"), (1, 6, "edit", "nobody", "user", "?"),
            (1, 7, "regenerate", "a", "assistant", "New"), (1, 8, "delta", None, None, "er"), (1, 9, "odd", None, "user", "ignored"), (1, 10, None, None, "user", None),
            (2, 1, "delta", None, "assistant", "starts"), (None, None, "message", None, None, "x"),
        ],
    )
    assert turns == {1: [("user", "hey"), ("assistant", "Newer"), ("user", "")], 2: [("assistant", "starts")], None: [("", "x")]}


def test_large_conversations_leave_in_parts(spark):
    rows = [(1, i, None, None, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(300)]
    turns, parts = render_log(spark, rows, part_chars=1000)
    assert len(parts[1]) > 20 and [p.part for p in parts[1]] == list(range(len(parts[1]))) and max(len(p.formatted) for p in parts[1]) < 2000
    assert [t for _, t in turns[1]] == [f"turn {i} " * 20 for i in range(300)]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "\\", "### x", ""]), st.text(alphabet="\\#</turn>\n:ab é", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_rendering_reads_back(turns):
    whole = [chat.render_turn(*t) for t in turns]
    assert chat.parse("".join(x for x, _, _ in whole)) == turns
    assert all(chat.unescape(x[s:e]) == t for (x, s, e), (_, t) in zip(whole, turns, strict=True))
    assert all(x.count("</turn>") == 1 and x.count("###") == 1 for x, _, _ in whole)


def test_chat_digests_and_empty_log(spark):
    log = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "é")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(log)).collect()[0]
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3, 1, hashlib.sha256("é".encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256("user\nq\nassistant\n\nassistant\né\n".encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(log.where("false"))).count() == 0


def test_chat_with_clashing_columns_long_texts_ties_and_repeats(spark):
    long = "x# </ \\" * 400_000
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "assistant", "a"), (1, None, "user", "first"), (2, 5, "assistant", long), (None, 1, None, None), (3, 1, "", "")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = plain.withColumns({c: F.lit("clash") for c in ("seq", "kind", "message", "open", "last", "of", "part", "formatted", "loss_starts")})
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(clash)).collect()}
    told = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == told([("user", "first"), ("assistant", "a"), ("user", "q"), ("user", "q")]) and got[1].n_turns == 4
    assert (got[2].loss_chars, got[2].turns_sha256) == (len(long), told([("assistant", long)]))
    assert got[None].turns_sha256 == got[3].turns_sha256 == told([("", "")]) and len(got) == 4


# quality


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join((word().upper() + "!!") if bad else word() for _ in range(40))))
        labels.append((i, int(not bad)))
    d, l = docs(spark, rows + [(1000, None), (1001, "")]), spark.createDataFrame(labels, "doc_id long, quality int")
    got = by_id(quality.classify_quality(d, l))
    assert all(got[i].predicted == q for i, q in labels) and got[1000].score == got[1001].score == 0.0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    flipped = l.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {i: r.score for i, r in by_id(quality.classify_quality(d, flipped)).items()} == {i: r.score for i, r in got.items()}
    kept = quality.keep_good(d, l)
    assert kept.columns == d.columns and kept.count() == sum(q for _, q in labels)


def test_quality_without_labels_and_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify_quality(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.0, 0.5}
    assert quality.classify_quality(docs(spark, []), none).count() == 0


def risk_rows(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, quality.WIDTH)).astype(np.float32)
    good = x[:, 0] + 0.3 * rng.standard_normal(n) > -0.8
    rows = [(False, int(i % 2), x[i].tobytes()) for i in range(n)] + [(True, int(i % 2), x[i].tobytes()) for i in range(n) if good[i] and i % 3]
    return x.astype(np.float64), good, spark.createDataFrame([(p, h, bytearray(b)) for p, h, b in rows], "positive boolean, half int, x binary").repartition(5)


@pytest.mark.parametrize("prior", [0.5, 0.95])
def test_the_non_negative_risk_is_at_its_minimum(spark, prior):
    """Against plain numpy over all rows: no small step in any direction lessens the risk, and its negative part isn't below zero."""
    x, good, frame = risk_rows(spark)
    scorer = quality.Scorer(x.mean(axis=0), x.std(axis=0) + 0.02, None, prior)
    w = quality.fit(quality.Rows(frame), scorer, prior)
    u = scorer.rows(x)
    p = u[good & (np.arange(len(x)) % 3 > 0)]
    loss = lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0)

    def risk(w):
        negative = loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()
        return prior * loss(p @ w).mean() + max(0, negative) + (quality._DECAY * w * w).sum() / 2, negative

    least, negative = risk(w)
    assert negative > -2 * quality.CLOSE
    rng = np.random.default_rng(1)
    assert all(risk(w + s)[0] > least - 2e-3 for s in rng.standard_normal((300, len(w))) * rng.choice([1e-3, 1e-2, 1e-1], (300, 1)))


def test_the_prior_is_estimated_from_the_rows():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        score = lambda n, good: np.clip(rng.normal(20 if good else 8, 4, n), 0, 31).astype(int)
        positives = np.bincount(score(20_000, True), minlength=32)
        unlabelled = np.bincount(np.concatenate([score(int(40_000 * share), True), score(int(40_000 * (1 - share)), False)]), minlength=32)
        assert abs(quality.best_bin(positives, unlabelled) - share) < 0.04


def test_sums_in_two_rounds_are_the_same(spark, monkeypatch):
    x, good, frame = risk_rows(spark, 100)
    count = lambda x, half: np.array([len(x), (half == 1).sum(), x.sum()])
    once = quality.Rows(frame).summed(count, 3)
    monkeypatch.setattr(quality, "SUMS", 2)
    assert np.allclose(quality.Rows(frame).summed(count, 3), once) and once[0, 0] == 100 and once[0, 1] == 50


# token counts


@given(st.lists(st.lists(st.integers(1, 9), max_size=25), max_size=3), st.integers(1, 5))
@settings(max_examples=8, deadline=None)
def test_scan_stitches_blocks(spark, files, size):
    rows, expected = [], []
    for f, ids in enumerate(files):
        rows += [(str(f), b // size, np.array(ids[b : b + size], "<u2").tobytes()) for b in range(0, len(ids), size)]
        start = k = 0
        for i, x in enumerate(ids):
            if x == 9:
                expected.append((str(f), k, start, i - start))
                start, k = i + 1, k + 1
        if start < len(ids):
            expected.append((str(f), k, start, len(ids) - start))
    got = token_scan.scan(spark.createDataFrame(rows, "file string, block int, tokens binary"), 9, size)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("file_bytes", [token_scan.FILE_BYTES, 64])
def test_counts_of_odd_texts(spark, monkeypatch, file_bytes):
    """Tables that come out of a shuffle, unlike each time; also with files of few documents."""
    monkeypatch.setattr(token_scan, "FILE_BYTES", file_bytes)
    bpe = token_scan.encoding()
    for d in (docs(spark, ODD).repartition(3), docs(spark, ODD).orderBy(F.rand()), docs(spark, ODD).withColumn("doc_id", F.concat(F.lit("é "), F.col("doc_id")))):
        got = token_scan.count_tokens(d).collect()
        name = (lambda i: i) if dict(d.dtypes)["doc_id"] == "bigint" else (lambda i: None if i is None else f"é {i}")
        assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((name(i), len(bpe.encode_ordinary(t or ""))) for i, t in ODD)
        assert len({(r.file_no, r.part, r.ordinal) for r in got}) == len(ODD)
    assert token_scan.count_tokens(docs(spark, [])).count() == 0


def test_separators_that_ids_could_hold_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="separator"):
        token_scan.write_token_files(docs(spark, ODD), f"{tmp_path}/t", separator=0x3030)


# simhash


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@given(st.text(alphabet="aAbBéÉ \t\x0b\x1c\xa0\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def partition(nodes, links):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_close_pairs_are_all_found_once_or_more(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 30).tolist() + [0, -1]
    seen = set(base)
    for b in base:
        for flips in itertools.chain([[32, 31, 0], [1, 2, 3], [40, 50, 60]], (rng.choice(64, n, replace=False).tolist() for n in (1, 2, 3, 4, 5))):
            x = b & (2**64 - 1)
            for f in flips:
                x ^= 1 << int(f)
            seen.add(x - 2**64 if x >= 2**63 else x)
    seen = sorted(seen)
    expected = {(a, b) for a, b in itertools.combinations(seen, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {tuple(sorted(r)) for r in simhash.close_pairs(spark.createDataFrame([(s,) for s in seen], "fp long")).collect()}
    assert got == expected
    roots = {r.node: r.component for r in components.components(spark.createDataFrame(sorted(expected), "a long, b long")).collect()}
    assert {n: roots.get(n, n) for n in seen} == partition(seen, expected)


def test_probes_are_not_broadcast(spark, tmp_path):
    """A table's file may be far below the bound for broadcasts, and its probes far above."""
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    pairs = simhash.close_pairs(prints.unionByName(prints.where("fp % 1000 = 0").selectExpr("fp ^ 5 as fp")).distinct())
    assert {frozenset(r) for r in pairs.collect()} == {frozenset((r.fp, r.fp ^ 5)) for r in prints.where("fp % 1000 = 0").collect()}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_documents_are_not_broadcast(spark, tmp_path):
    """Many equal texts make a small file."""
    spark.range(3000).selectExpr("id as doc_id", "repeat('many words here ', 100) as text").write.parquet(f"{tmp_path}/documents")
    d = spark.read.parquet(f"{tmp_path}/documents")
    _, last = broadcast_rows(spark, -1)
    assert sorted(map(tuple, simhash.near_duplicates(d).select("doc_id", "component_id").collect())) == [(i, 0) for i in range(3000)]
    rows, last = broadcast_rows(spark, last)
    assert max(rows, default=0) <= 1
    assert [r.doc_id for r in simhash.keep_one_of_each(d).collect()] == [0]
    rows, last = broadcast_rows(spark, last)
    assert max(rows, default=0) <= 1


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 300)}, 500: 499}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_texts(spark):
    near = LONG.replace("word word", "word other", 1)
    rows = ODD + [(9, near), (10, "no id here"), (3, "one id more")]
    got = simhash.shown(simhash.near_duplicates(docs(spark, rows)))
    assert got.count() == len(rows) and Counter((r.doc_id, r.fingerprint) for r in got.collect()) == Counter((i, f"{slow_fingerprint(t):016x}") for i, t in rows)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert found[1, "0" * 16] == found[2, "0" * 16] == found[3, "0" * 16] == 1
    assert found[9, f"{slow_fingerprint(near):016x}"] == 5 and found[None, f"{slow_fingerprint('no id here'):016x}"] == 10
    d = docs(spark, rows)
    kept = simhash.keep_one_of_each(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids)[4] == 1 and Counter(ids)[5] == 1 and 9 not in ids and 2 not in ids and None in ids
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# embeddings


VEC = "vec_id long, embedding array<float>, label int"


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.08])).astype(np.float32).tolist(), i % 3) for i in range(400)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[1][1], None), (None, rows[1][1], 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows + odd, VEC).withColumns({c: F.lit(1) for c in ("node", "key", "n", "fine", "copies")})
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    met = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(met, False)
    ids = [r[0] for r in rows]
    low = partition(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(met), strict=True)])
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids} == {i: (int(met[k].sum()), low[i], low[i] == i) for k, i in enumerate(ids)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (2000, 2001, 2002, 2003, 2004, None, 2005, 2008))
    assert got[2006].n_links == got[2007].n_links == 1 and got[2007].component_id == 2006
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_components_over_a_tile_are_counted_in_pairs_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    monkeypatch.setattr(embed_dedup, "WINDOW", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.01).tolist(), 1) for i in range(150)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, VEC)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_recall_where_windows_bind(spark):
    """Thousands of vectors of one label, far more than a window holds: links found, of those that brute force finds."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((700, 48))
    x = np.concatenate([base[rng.integers(0, 700, 3500)] + rng.standard_normal((3500, 48)) * rng.choice([0.06, 0.1, 0.14], (3500, 1)), rng.standard_normal((1500, 48))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    met = unit @ unit.T >= 0.98
    np.fill_diagonal(met, False)
    got = np.array([r.n_links for r in embed_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()])
    assert met.sum() > 5000 and (got <= met.sum(axis=1)).all() and got.sum() >= 0.99 * met.sum()


@pytest.mark.parametrize("kind, labels", [("string", ["a", "b", "a"]), ("double", [1.2, 1.9, 1.2]), ("boolean", [True, False, True]), ("double", [0.0, 1.0, -0.0])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 2.0 + i / 1e6], v) for i, v in enumerate(labels)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(1, 0), (0, 1), (1, 0)]


# pieces


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_encoding_is_the_librarys(text):
    encoder, library = pieces.tools(None)
    text = text.encode("utf-8", "ignore").decode()
    ids, starts, ends = encoder.encode(text)
    assert ids.tolist() == library.encode(text, add_eos=True)
    assert starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(text.encode())


@given(st.lists(st.text(alphabet="ab \n\u2581é#1", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_many_texts_are_encoded_alike_here_and_by_the_library(texts):
    kept, library = pieces.tools(None)
    here = pieces.Encoder(kept.model)  # merges all cuts itself
    both = pieces.Encoder(kept.model, library)
    for got in (list(here.encode_many(texts)), list(both.encode_many(texts)), list(both.encode_many(texts))):
        assert [x[0].tolist() for x in got] == [library.encode(t, add_eos=True) for t in texts]
        assert [int(x[2][-1]) for x in got] == [len(t.encode()) for t in texts]


def test_spans_point_at_the_source(spark):
    text = "Grüße,  Welt\n日本 x"
    row = pieces.encode_documents(docs(spark, [(1, text)])).collect()[0]
    raw, library = text.encode(), pieces.tools(None)[1]
    shown = [raw[s:e].decode("utf-8", "replace") for s, e in zip(row.starts, row.ends, strict=True)]
    assert "".join(raw[s:e].decode("latin-1") for s, e in zip(row.starts, row.ends, strict=True)).encode("latin-1") == raw
    assert [s for i, s in zip(row.ids, shown, strict=True) if library.id_to_piece(i) == "\u2581W"] in ([], [" W"])
    assert row.decoded == library.decode(list(row.ids)) == text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_character_maps(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = pieces.Model.read(library.serialized_model_proto())
    for text in ["", "  Ａｂｃ  ①２ ｶﾞ e\u0301 é ﬁ ", "   ", "ẞ ℌ…\t\u3000x", "한국 ㈱ İ ǅ", "ﷺ"]:
        norm, align = model.normalise(text)
        assert norm == library.normalize(text) and len(align) == len(norm.encode()) + 1
        assert (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_digests_of_odd_texts_and_long_cuts(spark):
    library = pieces.tools(None)[1]
    rows = ODD + [(20, "ab" * 30_000), (21, " " * 5000)]
    got = pieces.piece_digests(docs(spark, rows), with_ids=True).collect()
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, dict(rows).get(r.doc_id)))), strict=True):
        ids = library.encode(t or "", add_eos=True)
        assert (r.doc_id, r.ids, r.n_tokens) == (i, ids, len(ids)) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.n_source_bytes == len((t or "").encode())
    assert pieces.piece_digests(docs(spark, [])).count() == 0


# top-k


def slow_top_k(rows, k=5, every=5):
    able = [(i, np.floor(256 * np.array(e, np.float64)).astype(np.int64)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for q, w in able:
        if q % every == 0:
            scores = sorted((-int(w @ v), i) for i, v in able if i != q and len(v) == len(w))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.standard_normal(6), 1).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2005, [float("nan")] * 6), (2010, [None] + [1.0] * 5), (None, [1.0] * 6), (2015, [1.0, 2.0]), (2016, [-1.0, 3.0]), (2020, [0.0] * 6), (2025, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("size", "block", "q", "rank", "score")})
    got = top_k.exact_top_k(df, F.col("vec_id") % 5 == 0).drop("exact")
    assert sorted(map(tuple, got.collect())) == sorted(slow_top_k(rows))
    assert top_k.exact_top_k(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_of_vectors_of_any_size(spark, monkeypatch):
    """No finite vector is left out, scores beyond 64 bits are ranked exactly, and blocks and packs don't change results."""
    monkeypatch.setattr(top_k, "HELD", 64)
    big = [8388607.0, 8388608.0, 9e6, 2.0**53 + 2, -(2.0**60), 1e19, -1e19, 1e300, -1e300, 1.7e308, 5e-324, -5e-324, 0.1]
    rows = [(i, [v, 1.0, -v / 3, 1.0]) for i, v in enumerate(big * 2)] + [(100 + i, [float(i % 3)] * 4) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda v: Fraction(v) * 256 // 1
    for r in (got := top_k.exact_top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()):
        assert r.score == max(-(2**63), min(2**63 - 1, int(r.exact or r.score))) and (r.exact is None) == (-(2**63) <= int(r.exact or r.score) < 2**63)
    expected = []
    for q, x in rows:
        if q % 5 == 0:
            scores = sorted((-sum(whole(a) * whole(b) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])]
    assert sorted((r.query_id, r["rank"], r.vec_id, int(r.exact or r.score)) for r in got) == sorted(expected)


# mixing


def test_mixing_meets_reachable_targets(spark):
    rows = [(i, " ".join([f"a{i % 7}", f"a{i % 5}", "x"] * (i % 4 + 1)) if i % 3 else " ".join([f"b{i % 7}", f"b{i % 5}", "x"] * (i % 4 + 1))) for i in range(300)]
    labels = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(0, 300, 2)] + [(1, "other"), (None, "a")], "doc_id long, domain string")
    got = mixing.mix(docs(spark, rows), labels, {"a": 1, "b": 1}).collect()
    sums = np.sum([np.array(r.posteriors) * r.n_tokens * r.rate for r in got], axis=0)
    assert np.allclose(sums / sum(r.n_tokens for r in got), 0.5, atol=1e-3) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert all((r.posteriors[0] > 0.5) == bool(r.doc_id % 3) for r in got)
    d = docs(spark, rows)
    kept = mixing.mixed(d, labels, {"a": 1, "b": 1})
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_posteriors_and_tokens_are_those_of_plain_python(spark):
    """Terms, levels, posteriors and tokens against a naive Bayes classifier written out in Python."""
    rng = np.random.default_rng(11)
    domains, texts, labels = ["clean", "low", "toxic"], {}, {}
    for i in range(240):
        d = int(rng.choice(3, p=[0.6, 0.25, 0.15]))
        words = [f"w{rng.integers(40)}" for _ in range(12)] + [f"{domains[d]}{rng.integers(6)}" for _ in range(int(rng.integers(0, 5)))]
        texts[i] = (" " if i % 3 else "\n").join(rng.permutation(words)) + ("" if i % 5 else " it's 42!  \n x")
        if i % 4:
            labels[i] = domains[d]
    texts[500], texts[501] = None, ""
    got = by_id(mixing.mix(docs(spark, texts.items()), spark.createDataFrame(list(labels.items()), "doc_id long, domain string"), dict.fromkeys(domains, 1)))
    import regex

    assert all(r.n_tokens == len(regex.findall(mixing.TOKEN, texts[i] or "")) for i, r in got.items())
    cut_up = lambda t: {w for w in re.split("[ \n]", t or "") if w}
    size = [sum(d == x for x in labels.values()) for d in domains]
    prior = [np.log((n + 1) / (len(labels) + 3)) for n in size]
    have = {}
    for i, d in labels.items():
        for w in cut_up(texts[i]):
            have.setdefault(w, [0, 0, 0])[domains.index(d)] += 1
    speaks = {}
    for w, n in have.items():
        tells = 0.0
        for k in (1, 2):
            share = sum(n) / sum(size)
            expected = share * size[k]
            if (n[k] + 0.5) / (size[k] + 1) >= mixing.STRONG * (n[0] + 0.5) / (size[0] + 1):
                tells = max(tells, (n[k] - expected) / np.sqrt(expected * (1 - share) + 1e-9))
        if sum(n) >= mixing.LEAST and tells >= mixing.SURE:
            odds = [np.log((n[k] + 0.5) / (size[k] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1)) for k in (1, 2)]
            speaks[w] = [max(o, 0) if o == max(odds) else 0 for o in odds]
    assert 8 <= len(speaks) < mixing.TERMS

    def levels(t):
        sums = np.sum([np.round(speaks[w], 4) for w in cut_up(t) if w in speaks], axis=0) if cut_up(t) & set(speaks) else [0, 0]
        return [1 if e == 0 else 2 if e < mixing.GRADES[0] else 3 if e < mixing.GRADES[1] else 4 for e in sums]

    seen = np.full((3, 2, 4), 0.5)
    for i, d in labels.items():
        for k, level in enumerate(levels(texts[i])):
            seen[domains.index(d), k, level - 1] += 1
    chances = np.log(seen / seen.sum(axis=2, keepdims=True))
    for i, r in got.items():
        logits = [prior[j] + sum(chances[j, k, level - 1] for k, level in enumerate(levels(texts[i]))) for j in range(3)]
        p = np.exp(logits - np.max(logits))
        assert np.allclose(r.posteriors, p / p.sum(), atol=1e-3)
    counted = docs(spark, texts.items()).withColumn("mine", F.length("text"))
    theirs = mixing.mix(counted, spark.createDataFrame(list(labels.items()), "doc_id long, domain string"), dict.fromkeys(domains, 1), tokens="mine", terms=3)
    assert all(r.n_tokens == len(texts[r.doc_id] or "") for r in theirs.collect())


def test_mixing_odd_cases(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(docs(spark, ODD), none, {"a": 1, "b": 3}).collect()
    assert len(got) == len(ODD) and all(np.allclose(r.posteriors, 0.5) for r in got) and all(np.isfinite(r.rate) for r in got)
    assert {r.rate for r in mixing.mix(docs(spark, [(1, None), (2, " ")]), none, {"a": 1, "b": 3}).collect()} == {1.0}
    assert mixing.mix(docs(spark, []), none, {"a": 1}).count() == 0 and mixing.mixed(docs(spark, []), none, {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, ODD), none, {"a": 0})


# language


def slow_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


@given(st.text(alphabet="abcAé ?1", min_size=1, max_size=60), st.text(alphabet="abc é", min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_phrases_are_longest_matches(text, sample):
    parser = language.CrossParser({"x": sample, "y": "qq"})
    squeezed = lambda t: re.sub(" +", " ", "".join(" " if not c.isalpha() else c.lower() if c.lower() in sample + "qq" else "?" for c in t))
    plain = squeezed(text)
    counts, sizes = parser.phrases([text, text + text, text])
    assert counts[[0, 2]].tolist() == [[slow_phrases(plain, squeezed(sample)), slow_phrases(plain, "qq")]] * 2
    assert sizes.tolist() == [len(plain), len(squeezed(text + text)), len(plain)]


@pytest.mark.parametrize("held", [language.HELD, 4 * language.SEGMENT])
def test_phrases_run_on_over_segments(monkeypatch, held):
    """Texts of many segments, against plain Python over the whole text; also where a walk holds two segments at a time."""
    monkeypatch.setattr(language, "HELD", held)
    rng = np.random.default_rng(8)
    for letters in ("ab", "abcdefgh ", "abc "):
        word = lambda n, of=letters: re.sub(" +", " ", "".join(rng.choice(list(of), n)))
        samples = {"x": word(600), "y": word(60), "z": word(9)}
        texts = [word(n, letters + "q") for n in (4000, 255, 1, 256, 257, 512, 1500)]
        counts, sizes = language.CrossParser(samples).phrases(texts)
        assert counts.tolist() == [[slow_phrases(t, samples[k]) for k in "xyz"] for t in texts] and sizes.tolist() == list(map(len, texts))


def test_large_alphabets_are_kept_whole():
    many = "".join(chr(0x4E00 + i) for i in range(3000))
    parser = language.CrossParser({"x": many, "y": "abc"})
    text = many[1000:1010] + many[5:9] + "b" + many[2999]
    assert parser.phrases([text])[0].tolist() == [[4, len(text)]]
    assert len(parser.owner) < 4 * 3000 + 4 * 3000  # as many places as transitions, not states times letters


def test_language_of_ties_repeats_and_clashing_columns(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 40)] + [(500, "same words", None)] * 3 + [(None, "same words", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("x", "lang_pred", "held_out", "score", "id", "order", "rank", "reach", "at", "identified")})
    samples = language.learn_samples(d)
    assert set(samples) == {"a", "b"}
    tied = language.CrossParser({k: "same words here" for k in "ba"})
    assert tied.predict(["same words"])[0] == ["a"]
    got = language.identify_languages(d)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    assert len({(r.lang_pred, r.score) for r in got.where("doc_id = 500").collect()}) == 1
    kept = language.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows)
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="more than 1 languages"):
        m.setattr(language, "LANGUAGES", 1)
        language.learn_samples(d)


def test_languages(spark):
    rng = np.random.default_rng(6)
    talk = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    rows = [(i, talk(["ka", "lo", "mi"]) if i % 2 else talk(["the", "ing", "er"]), "xx" if i % 2 else "yy") for i in range(200)]
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "", None), (902, "12 !", "yy"), (903, LONG, None), (None, "the ing", "yy")], "doc_id long, text string, lang string")
    got = by_id(language.identify_languages(d))
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = language.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows) + 2
    assert {r.lang_pred for r in language.identify_languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify_languages(d.where("false")).count() == 0


# urls


def test_url_parts_and_rules(spark):
    urls = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://com": ("com", "", "com/", "allow"),
        "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/es": ("b.net", "/es", None, "allow"),
        "http://spam-farm.example.org/": ("spam-farm.example.org", "/", None, "block"),
        "http://b.org#spam-farm.": ("b.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://x.org/wp-login.php?a": ("x.org", "/wp-login.php", None, "block"),
        "http://a.casino-win.org/x": ("a.casino-win.org", "/x", None, "block"), "http://a.casinox.org/x": ("a.casinox.org", "/x", None, "allow"),
        "http://x.org/a/setup.exe#1": ("x.org", "/a/setup.exe", None, "block"), "http://x.org/a.exe.html": ("x.org", "/a.exe.html", None, "allow"),
        "http://x.org/t?b=1&SessionId=9": ("x.org", "/t", None, "block"), "http://x.org/login/help": ("x.org", "/login/help", None, "block"),
    }
    rows = [(i, u) for i, u in enumerate([*urls, *urls])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(df).collect()}
    assert got == {i: urls[u] for i, u in rows} and url_rules.judge_urls(df.where("false")).count() == 0


PARTS = ["spam-farm", "casino", "wp-login.php", "a.b", "?affiliate_id=9", "http://", "/", ".org", ".zip", "é", "-", "x", "&sessionid=", "/login", "LOGIN"]


@given(st.lists(st.sampled_from(PARTS), max_size=6).map("".join))
@settings(max_examples=500, deadline=None)
def test_the_index_changes_nothing(url):
    judge = url_rules.Judge(url_rules.SITE_RULES, url_rules.PATTERN_RULES, {"spam": 5, "farm": 2, "login": 1})
    assert judge.pattern(url) == ("block" if any(re.search(r.pattern, url.lower()) for r in url_rules.PATTERN_RULES) else "allow")


def test_few_rules_are_tried_and_some_decide():
    """Every production rule has a token, hits a url of its own, and is one of few that run there."""
    judge = url_rules.Judge((), url_rules.PATTERN_RULES, {})
    assert not judge.always and len(url_rules.PATTERN_RULES) > 100
    urls = [f"http://a.{w}.org/" for w in url_rules.HOST_WORDS] + [f"http://a.org/b/{w}/c" for w in url_rules.PATHS]
    urls += [f"http://a.org/b?{w}=1" for w in url_rules.PARAMETERS] + [f"http://a.org/b.{w}" for w in url_rules.FILES]
    assert len(urls) == len(url_rules.PATTERN_RULES) and all(judge.pattern(u) == "block" and len(judge.candidates(u)) < 4 for u in urls)
    assert all(judge.pattern(u) == "allow" and not judge.candidates(u) for u in ("http://a.org/en/12.html", "http://news.org/sports?page=2", "http://sussex.ac/"))


ATOMS = st.sampled_from(["ab", "c9", "/", r"\.", "[.-]", "[a-c]", "[^a-z0-9]", ".", "^", "$", r"\b", "é", "[^/]*", "x?", "(/ab)?", "(ab|/c)", "([/?]|$)", "(-a-)+", "c*"])


@given(st.lists(ATOMS, min_size=1, max_size=5).map("".join), st.lists(st.sampled_from(["ab", "c9", "/", ".", "-", "a", "c", "x", "é", "?", "-a-"]), max_size=8).map("".join))
@settings(max_examples=3000, deadline=None)
def test_required_tokens_are_in_every_hit(pattern, text):
    if re.search(pattern, text):
        assert set(url_rules.required_tokens(pattern)) <= set(re.findall(url_rules.TOKEN, text))


def test_tokens_follow_from_patterns():
    expected = {
        r"://([^/?#]*[.-])?casino([.-][^/?#]*)?([/?#]|$)": ("casino",), r"/wp-login\.php([?#]|$)": ("wp", "login", "php"), r"[?&]id=[a-z]+": ("id",),
        "foo": (), "^foo$": ("foo",), "/foo": (), "/(foo|bar)/": (), "/(ab)?cd/": (), "a+/x1/": ("x1",),
    }
    assert {p: url_rules.required_tokens(p) for p in expected} == expected


def test_rules_from_a_table(spark):
    many = [("block", f"/item{i}x/") for i in range(3000)] + [("allow", "/item7x/ok"), (None, "/a/"), ("block", None), ("block", "/item7x/")]
    rules = spark.createDataFrame(many, "verdict string, pattern string")
    pages = spark.createDataFrame([(i, f"http://a.org/item{i}x/") for i in range(2990, 3010)] + [(7, "http://a.org/item7x/ok")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, patterns=rules).collect()}
    assert got == {**{i: "block" if i < 3000 else "allow" for i in range(2990, 3010)}, 7: "block"}
    with pytest.raises(ValueError, match="verdict"):
        url_rules.rules_of([url_rules.PatternRule("maybe", "x")])
