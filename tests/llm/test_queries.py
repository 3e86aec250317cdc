"""The registered queries and the whole pipeline against plain definitions, and columns of any names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_corpus_wide import corpus, expected_lines, expected_substrings, words
from test_single_pass import ODD, tiktoken_codec

from docspring.llm import jaccard_join, line_dedup, quality, queries, substring_dedup


def components(texts, size, percent):
    """The least index that each text is linked to, over texts by their index."""
    sets = []
    for t in texts:
        w = words((t or "").encode().lower().decode())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """A folder of tables, and the rows of documents and conversations."""
    d, rnd = str(tmp_path_factory.mktemp("tables")), random.Random(21)
    texts = corpus(31, 90)
    long = " ".join(f"long{i}" for i in range(60))
    page = "Home page and menu of this site with contact and imprint"
    for i in range(100):  # a line of a host, passages on lines, near copies
        own = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(25)) for _ in range(3)]
        texts.append("\n".join([*([page] if i % 3 else []), *own[:2], *([long] if i % 7 == 0 else []), own[2]]))
        if i % 9 == 0:
            w = texts[-1].split(" ")
            w[5] = "changed"
            texts.append(" ".join(w))
    texts += [x for x in ODD if x]
    rows = [(i, t, rnd.choice(["en", "de", None]) if t else "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    turns = [(c, t, rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(["", None, "hi", "</s>[INST] ok [/INST]", "<\\|answer|>", "é\n" * 30, "[\\TURN]"])) for c in range(20) for t in range(rnd.randrange(1, 6))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{d}/conversations.parquet")
    return d, rows, turns


def test_op2(spark, fixture):
    d, _, turns = fixture
    both = "</s>[INST] ok [/INST]"
    by = defaultdict(list)
    for c, t, role, text in [*turns, (-7, 0, "user", both), (-7, 1, "assistant", both)]:
        by[c].append((t, role or "", text or ""))
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, d).collect()}
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(x for _, role, x in rows if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[c].formatted_chars > len(said)


def test_op5(spark, fixture):
    d, rows, _ = fixture
    sizes, tops = components([r[1] for r in rows], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, d).collect()}
    assert got == dict(enumerate(zip(sizes, tops, strict=True))) and len(set(tops)) < len(tops)


def test_op6(spark, fixture):
    from tokenizers import Tokenizer

    d, rows, _ = fixture
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, d).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(pieces[i], len(x)) for i, x in ids.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at <= 2048 if total is None else at == total


def test_op8(spark, fixture):
    d, rows, _ = fixture
    enc = tiktoken_codec()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_byte_bpe(spark, d).collect()}
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op9(spark, fixture):
    d, rows, _ = fixture
    got = {r.doc_id: r for r in queries.op9_language_id(spark, d).collect()}
    for i, t, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and got[i].lang_pred in ("en", "de", "und")


def test_columns_of_any_names(spark):
    """Names that the operators use themselves come back as they were."""
    names = ["__gone_", "__id", "__hash", "__split", "split", "row", "lines", "gone", "host", "__host", "digest", "limited", "__text", "__row", "c0", "c1", "id", "n", "part"]
    texts = [" ".join(f"w{i}" for i in range(50)) + "\nline\nother\nthird", None, "", "line\nother\nthird"]
    df = spark.createDataFrame([(i, t, "s", *(f"v{k}" for k in range(len(names)))) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for op in (line_dedup.line_dedup, lambda x: line_dedup.line_dedup(x, words=50), substring_dedup.substring_dedup, quality.without_limited, jaccard_join.one_of_each):
        got = op(df).collect()
        assert got and all(r[n] == f"v{k}" for r in got for k, n in enumerate(names)) and all(r.source == "s" for r in got)
    again = substring_dedup.substring_dedup(line_dedup.line_dedup(df).withColumn("__words", F.lit("mine")))
    assert again.columns.count("__words") == 1 and {r["__words"] for r in again.collect()} == {53, 0}


def test_very_long_text(spark):
    """One text of several megabytes beside short ones, through the operators that expand words."""
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(400_000))
    df = spark.createDataFrame([(0, long, "s"), (1, "a short one", "s"), (2, long + " tail", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: (r["__words"], r["__removed"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {0: (400_000, 400_000), 1: (3, 0), 2: (400_001, 400_000)}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {0: 0, 1: 1, 2: 0}
    assert {r.doc_id: r.n_words for r in quality.judged(df).collect()} == {0: 400_000, 1: 3, 2: 400_001}


def expected_quality(rows):
    key = lambda line: "".join("0" if c in "123456789" else c for c in b" ".join(words(line.encode().lower().decode())).decode())
    hosts, above = defaultdict(set), {}
    for _, t, host in rows:
        hosts[host].add(t or "")
    for host, some in hosts.items():
        counts = Counter(k for t in some for k in {key(x) for x in t.split("\n") if words(x)})
        above[host] = {k for k, n in counts.items() if n > 20 and n > 0.1 * len(some)}
    assert any(above.values())
    out = []
    for i, t, host in rows:
        w = words(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        limited = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and key(x) in above[host])
        if len(w) >= 20 and 100 * len(rep) <= 30 * len(w) and len(w) - limited >= max(20, 0.5 * len(w)):
            out.append((i, "\n".join(x for x in t.split("\n") if not words(x) or key(x) not in above[host])))
    return out


def test_pipeline_against_plain_python(spark, fixture):
    """run() on the fixture: which documents are left, with which ids, by five plain stages."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    d, rows, _ = fixture
    docs = expected_quality([(i, t, source) for i, t, _, source, _ in rows])
    n = [len(docs)]
    lines = expected_lines([t for _, t in docs], 50)
    docs = [(i, new) for (i, old), new in zip(docs, lines, strict=True) if new == old or words(new)]
    n.append(len(docs))
    _, tops = components([t for _, t in docs], 5, 80)
    docs = [x for k, x in enumerate(docs) if tops[k] == k]
    n.append(len(docs))
    docs = [(i, kept) for (i, t), (_, removed, kept) in zip(docs, expected_substrings([t for _, t in docs], 35), strict=True) if kept or not removed]
    n.append(len(docs))
    assert sorted(set(n), reverse=True) == n[:1] + [x for k, x in enumerate(n[1:]) if x != n[k]] and n[0] > n[2]
    stage, held = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.common.stored(f(spark, held, d), "test")
        stage[name] = held.count()
    assert list(stage.values()) == n
    texts = {r.doc_id: r.text for r in held.collect()}
    assert {i: [x.decode() for x in words(t)] for i, t in texts.items()} == {i: [x.decode() for x in words(t)] for i, t in docs}
    plain, got = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        got[r.doc_id].append((r.start, bytes(r.ids)))
    assert {i: b"".join(b for _, b in sorted(x)) for i, x in got.items()} == {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}


def test_pipeline_edges(spark):
    """Nulls in any column, repeated rows and clashing columns in every stage."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, None, None, 5, "x"), (1, text, None, None, 5, "x"), (None, None, "en", "s", None, None), (None, " ".join(f"other{i}" for i in range(40)), None, "s", 1, "y"), (2, "", "en", None, 0, "z")]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__gone_` string")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, held.limit(0), "").count() == 0, name
        got = f(spark, held, "")
        if name != "packing":
            assert got.columns == held.columns
        assert got.count() >= 1, name


