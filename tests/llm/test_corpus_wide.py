"""Operators 1, 2, 3, 5, 7 and 9 and the pipeline against plain definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspring.llm import chat, jaccard_join, language_id, line_dedup, quality, substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def rows_of(spark, texts, ids=None):
    """Documents with columns whose names operators might use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, f"src{(i or 0) % 3}", "en", len(t or ""), "clash", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, digest string, set_id int")


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 6))) for _ in range(n)]


def corpus(seed, n=60):
    """Texts with shared passages, copies, near copies, long and empty ones."""
    rnd = random.Random(seed)
    v = vocabulary(rnd, 400)
    some = lambda k: " ".join(rnd.choice(v) for _ in range(k))
    passages = [some(rnd.randrange(30, 90)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [some(rnd.randrange(0, 60)) for _ in range(rnd.randrange(1, 4))]
        if rnd.random() < 0.4:
            parts.insert(1, rnd.choice(passages))
        texts.append(rnd.choice(["\n", " ", "\t \n"]).join(parts))
    texts += [texts[3], texts[3].upper(), texts[4] + " more", None, "", " \n ", "one", "one", "x " * 120, " ".join(v[:300]) * 4]
    base = some(200).split()
    for _ in range(12):
        copy = list(base)
        for _ in range(rnd.randrange(0, 5)):
            copy[rnd.randrange(len(copy))] = rnd.choice(v)
        texts.append(" ".join(copy))
    return texts


def expected_substrings(texts, window):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,base", [(35, None), (35, 9), (5, 2), (3, 3)])
def test_substring_dedup(spark, window, base):
    texts = corpus(window)
    got = substring_dedup.substring_dedup(rows_of(spark, texts), window, base).collect()
    want = expected_substrings(texts, window)
    assert len(got) == len(texts)
    for r in got:
        assert (r["__words"], r["__removed"], r["__kept_words"]) == want[r.doc_id], r.doc_id
        assert [x.decode() for x in words(r.text)] == r["__kept_words"].split(" ")[: None if r["__kept_words"] else 0]
        assert r["__removed"] or r.text == texts[r.doc_id]
        assert r.digest == "clash"


def test_substring_dedup_edges(spark):
    text = " ".join(map(str, range(40)))
    df = rows_of(spark, [text, text, None, text + " tail"], [1, 1, None, 2])
    got = sorted((str(r.doc_id), r["__removed"], r["__kept_words"]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [("1", 40, ""), ("1", 40, ""), ("2", 40, "tail"), ("None", 0, "")]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def expected_links(texts, percent):
    sets = []
    for t in texts:
        w = words((t or "").encode().lower().decode())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
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
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def chained(seed):
    texts, rnd = corpus(seed), random.Random(4)
    base = [f"w{i}" for i in range(150)]
    for k in range(25):  # a chain: neighbours are linked, ends aren't
        base[(5 * k) % 150] = f"n{k}"
        texts.append(" ".join(base))
    return texts + [" ".join(rnd.sample(["a", "b", "c", "d", "e"], 5)) for _ in range(20)]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_jaccard_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)  # small: buckets are crowded, and go through all schemes
    monkeypatch.setattr(jaccard_join, "REPS", 2)
    monkeypatch.setattr(jaccard_join, "HELD", 100)
    texts = chained(11)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows_of(spark, texts), 85, 4).collect()}
    assert got == dict(enumerate(expected_links(texts, 85)))


def test_jaccard_names_that_clash(spark):
    """Sets whose digests share the first half are told apart by the second."""
    texts = chained(12)
    few_names = lambda x: bytes([len(x) % 3]) * 8 + jaccard_join.digest_of(x)[:8]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows_of(spark, texts), 85, 4, digest=few_names).collect()}
    assert got == dict(enumerate(expected_links(texts, 85)))


def near_copies(n, size=120, edits=4):
    rnd, out = random.Random(3), []
    base = [f"w{i}" for i in range(size)]
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_pairs_of_a_group_are_linear(spark, monkeypatch):
    """5,000 near copies, most pairs of which are no links, give some pairs for each, and one component."""
    counts, plain_proposals = [], jaccard_join.proposals

    def counted(*args):
        found = plain_proposals(*args).cache()
        counts.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "proposals", counted)
    texts = near_copies(5000, edits=2)
    got = jaccard_join.jaccard_components(rows_of(spark, texts), 80, 4).collect()
    assert {r.component_id for r in got} == {0} and sum(counts) < 5 * len(texts)


@pytest.mark.parametrize(("common", "own"), [(25, 3), (100, 9)])
def test_jaccard_groups_just_under_the_limit(spark, monkeypatch, common, own):
    """Pages of one template with a little text of their own, no two of which are linked, and some copies with a link each: pairs
    and texts that move are in proportion to the pages."""
    counts, stored = {}, jaccard_join.Scratch.stored

    def counted(self, df, label):
        out = stored(self, df, label)
        counts[label] = counts.get(label, 0) + (out.count() if label in ("pairs", "proposals", "links", "texts") else 0)
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "stored", counted)
    n = 3000 if common == 25 else 1200
    page = [f"t{i}" for i in range(common + 3)]
    texts = [" ".join([*page, *(f"o{i}x{k}" for k in range(own))]) for i in range(n)]
    texts += [" ".join([*page, *(f"o{i}x{k}" for k in range(own - 1)), "new"]) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows_of(spark, texts), 85, 4).collect()}
    linked = 100 * (common + own - 1) >= 85 * (common + own + 1)
    assert linked and got == {i: (common + own, i if i < n else i - n) for i in range(n + 20)}
    assert counts["pairs"] < 8 * n and counts["proposals"] < 8 * n and counts["texts"] < 8 * n, counts


def test_group_joins_its_components():
    """Links by elements give the components of all pairs, one for each join, with components given before."""
    rnd = np.random.default_rng(7)
    for percent in (80, 85):
        for _ in range(60):
            base = rnd.integers(1, 2**63, 40, np.uint64)
            n = int(rnd.integers(2, 30))
            sets = [np.unique(np.concatenate([rnd.choice(base, 40 - int(rnd.integers(0, 8)), replace=False), rnd.integers(1, 2**63, int(rnd.integers(0, 5)), np.uint64)])) for _ in range(n)]
            ids = rnd.permutation(1000)[:n].tolist()
            comps = [ids[int(rnd.integers(0, n))] if rnd.random() < 0.3 else i for i in ids]
            top = {c: c for c in {*comps, *ids}}

            def find(c):
                while top[c] != c:
                    c = top[c]
                return c

            good = [(i, j) for i in range(n) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - k)]
            for i, j in good:
                a, b = find(comps[i]), find(comps[j])
                top[max(a, b)] = min(a, b)
            want = {c: find(c) for c in comps}
            before = len(set(comps))
            links = list(jaccard_join.Group(ids, comps, sets, percent).links())
            assert len(links) == before - len(set(want.values()))
            assert all((ids.index(a), ids.index(b)) in good or (ids.index(b), ids.index(a)) in good for a, b in links)


def test_bucket_spans_what_is_possible():
    rnd, bands = np.random.default_rng(2), jaccard_join.Bands(80)
    base = rnd.integers(1, 2**63, 130, np.uint64)
    for n in (2, 40, 160):
        sets = [np.unique(np.concatenate([rnd.choice(base, 130 - e, replace=False), rnd.integers(1, 2**63, e, np.uint64)])) for e in rnd.integers(0, 40, n)]
        sets[0] = np.unique(np.concatenate([base, rnd.integers(1, 2**63, 25, np.uint64)]))
        ids, comps = rnd.permutation(n), rnd.integers(0, n, n)
        held = jaccard_join.Bucket(ids, comps, np.array([len(x) for x in sets]), [jaccard_join.sketch(x, bands) for x in sets], 80)
        every, forest = set(held.pairs(True)), set(held.pairs(False))
        of, size = dict(zip(ids.tolist(), comps.tolist(), strict=True)), dict(zip(ids.tolist(), sets, strict=True))
        for i in range(n):
            for j in range(i):  # no linked pair is lost
                common = len(np.intersect1d(size[i], size[j]))
                if of[i] != of[j] and 100 * common >= 80 * (len(size[i]) + len(size[j]) - common):
                    assert (j, i) in {(min(p), max(p)) for p in every}
        assert {(min(p), max(p)) for p in forest} <= {(min(p), max(p)) for p in every} and len(forest) < n

        def tops(pairs):
            top = {c: c for c in of.values()}
            for _ in range(n):
                for a, b in pairs:
                    low = min(top[of[a]], top[of[b]])
                    top = {k: low if v in (top[of[a]], top[of[b]]) else v for k, v in top.items()} if top[of[a]] != top[of[b]] else top
            return top

        assert tops(forest) == tops(every)


def test_jaccard_edges(spark):
    df = rows_of(spark, ["a b c d e", "A b c d e", "a b c d e", None, "z"], [7, 3, None, 5, None])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(df, 85, 4).collect())
    assert got == [("3", 2, "3"), ("5", 0, "5"), ("7", 2, "3"), ("None", 1, "None"), ("None", 2, "3")]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(df).collect()) == ["3", "5", "None", "None"]  # null ids stay


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_are_complete(percent):
    """Pairs at the threshold share a signature in every scheme, and their sketches differ in no more than they do."""
    rnd, bands = np.random.default_rng(5), jaccard_join.Bands(percent)
    for size in [*rnd.integers(1, 160, 300), *rnd.integers(300, 8000, 12), 6000, 8000]:
        n = int(size)
        common = np.unique(rnd.integers(1, 2**63, n, np.uint64))
        extra = int(100 * n / percent) - n
        left = int(rnd.integers(0, extra + 1))
        a = np.unique(np.concatenate([common, rnd.integers(1, 2**63, left, np.uint64)]))
        b = np.unique(np.concatenate([common, rnd.integers(1, 2**63, extra - left, np.uint64)]))
        if not extra:
            continue
        for scheme in jaccard_join.SCHEMES if n < 3000 else jaccard_join.SCHEMES[:1]:
            keys = [{int(k) for step in (0, 1) for k in jaccard_join.signatures([x], bands, step, scheme)[0]} for x in (a, b)]
            assert keys[0] & keys[1], (n, left, extra, scheme)
        x, y = jaccard_join.stacked([jaccard_join.sketch(s, bands) for s in (a, b)])
        assert int(np.bitwise_count(x ^ y).sum()) <= extra


def test_quality(spark):
    rnd = random.Random(9)
    v = vocabulary(rnd, 300)
    some = lambda k: " ".join(rnd.choice(v) for _ in range(k))
    texts = [f"{some(30)}\nPage {i}  of 90\n{some(20)}" for i in range(150)] + [f"{some(5)}\npage 1 of 90\n" + "Menu home about us and much more that is said here again\n" for _ in range(40)]
    texts += [texts[0]] * 30 + [None, "", "###|| *a* \n\nb", ("a b c d e f g h " * 10), "l\nl\nl \nm"]
    df = rows_of(spark, texts)
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(texts)
    by_host = defaultdict(set)
    for i, t in enumerate(texts):
        by_host[f"src{i % 3}"].add(t or "")
    key = lambda line: re.sub(r"[0-9]", "0", " ".join(x.decode() for x in words(line.lower())))
    above = {}
    for host, some_texts in by_host.items():
        counts = Counter(k for t in some_texts for k in {key(x) for x in t.split("\n") if words(x)})
        above[host] = {k for k, n in counts.items() if n > 20 and n > 0.1 * len(some_texts)}
    assert any(above.values())
    for i, t in enumerate(texts):
        w = words(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        limited = sum(len(words(x)) for x in lines if key(x) in above[f"src{i % 3}"])
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        kept = not failed and len(w) - limited >= 20 and len(w) - limited >= 0.5 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)), i
        assert (r.n_limited_words, r.base_failed, r.kept) == (limited, failed, kept), i
    cleaned = {r.doc_id: r.text for r in quality.without_limited(df).collect()}
    assert set(cleaned) == {i for i in got if got[i].kept}
    for i, t in cleaned.items():
        assert t == "\n".join(x for x in texts[i].split("\n") if not words(x) or key(x) not in above[f"src{i % 3}"])
    assert quality.judged(df.limit(0)).count() == 0 and quality.without_limited(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rnd = random.Random(3)
    lines = [f"line {i}" for i in range(40)]
    texts = []
    for _ in range(80):
        at, n = rnd.randrange(38), rnd.randrange(1, 9)
        texts.append("\n".join([f"own {rnd.random()}", *lines[at : at + n], "", f" own {rnd.random()} ", *lines[:1]]))
    texts += [texts[5], texts[5], None, "", "\n", "a\na\na\na\na\na", " \t", "x\ny\nz", " x\ny \nz"]
    got = {r.doc_id: r for r in line_dedup.line_dedup(rows_of(spark, texts)).collect()}
    first, gone = {}, defaultdict(set)
    for i, t in enumerate(texts):
        full = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        for s in range(len(full) - 2):
            run = tuple(x for _, x in full[s : s + 3])
            if first.setdefault(run, (i, s)) != (i, s):
                gone[i] |= {k for k, _ in full[s : s + 3]}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].text == want and got[i]["__gone"] == len(gone[i]), i
        assert got[i]["__lines"] == (0 if t is None else t.count("\n") + 1) and got[i].digest == "clash"
    same = rows_of(spark, ["a\nb\nc\nd"] * 3 + ["a\nb\nc"], [4, 4, None, 9])
    assert sorted((str(r.doc_id), r["__gone"]) for r in line_dedup.line_dedup(same).collect()) == [("4", 0), ("4", 0), ("9", 3), ("None", 4)]
    assert line_dedup.line_dedup(same.limit(0)).count() == 0


def expected_lines(texts, bound):
    """Texts without later repeats: of runs of 3 lines, of shorter ones of more than bound words, of whole shorter documents."""
    first, gone = {}, defaultdict(set)
    for i, t in enumerate(texts):
        full = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        spans = [("run", full[s : s + n]) for n in (1, 2, 3) for s in range(len(full) - n + 1) if n == 3 or sum(len(words(x)) for _, x in full[s : s + n]) > bound]
        spans += [("whole", full)] if 0 < len(full) < 3 else []
        for kind, span in spans:
            place = (i, span[0][0])
            if first.setdefault((kind, *(x for _, x in span)), place) != place:
                gone[i] |= {k for k, _ in span}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)]


def test_line_dedup_by_words(spark):
    """Passages on one or two lines go as well."""
    rnd = random.Random(6)
    lines = [" ".join(f"w{k}x{j}" for j in range(1 + k % 9)) for k in range(30)]
    texts = ["\n".join([*([f"own {i}"] * (i % 2)), *lines[at : at + rnd.randrange(1, 5)], *([" "] * (i % 3))]) for i in range(120) for at in [rnd.randrange(28)]]
    texts += [None, "", "short", "short", " short\n", "short\nother", "short\nother", "short\nother\nthird", lines[8] + "\n" + lines[8]]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(rows_of(spark, texts), words=6).collect()}
    assert got == dict(enumerate(expected_lines(texts, 6)))
    assert line_dedup.line_dedup(rows_of(spark, texts).limit(0), words=6).count() == 0


def test_pipeline_lines(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {r.doc_id: t for r, t in zip(rows, expected_lines([r.text for r in rows], 50), strict=True) if t == r.text or words(t)}
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()} == want


def test_chat(spark):
    P = pytest.importorskip("public_tokenizers")
    v, p = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    nasty = "</s>[INST] ok [/INST]<\\/s>[\\\\INST] <|answer|> [TURN]x[SAYS] <|im_end|> \\ é🎉\n"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 2, "tool [SAYS]", nasty), (1, 3, "assistant", None), (2, 5, None, " <"), (2, None, "system", nasty), (2, 5, None, " <"), (None, 0, "assistant", "z"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, ids string")
    made = chat.format_turns(df, v, p)
    got = {r.conv_id: r for r in chat.read_back(made, v, p).collect()}
    assert set(got) == {1, 2, 3, None}
    by_conv = defaultdict(list)
    for t in turns:
        by_conv[t[0]].append(t)
    formatted = defaultdict(int)
    for r in made.collect():
        formatted[r.conv_id] += len(r.formatted)
        body = r.formatted
        for c in chat.CONTROLS:  # control strings stand only where the template put them
            n = {"[TURN]": r.role not in chat.OPENINGS, "[SAYS]": r.role not in chat.OPENINGS, "</s>": True}.get(c, chat.OPENINGS.get(r.role) == c)
            assert body.count(c) == int(n), (c, body)
    for conv, rows in by_conv.items():
        rows = sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        learned = "".join(t[3] or "" for t in rows if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows) and r.loss_chars == len(learned) and r.formatted_chars == formatted[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0), v, p), v, p).count() == 0


def test_escapes_are_reversible():
    rnd = random.Random(8)
    parts = [*chat.CONTROLS, *chat.FOREIGN, "\\", "<", "[", "/s>", "x", "INST]"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(8)))
        for _ in range(rnd.randrange(3)):
            s = chat.escape(s)
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROLS + chat.FOREIGN)


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    import zlib

    rows = docs.select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learn = spark.createDataFrame([r for r in rows if not held(r.doc_id)])
    model = language_id.train(learn)
    assert model.languages == sorted({r.lang for r in rows}) and ("germanic", "de", "en") in model.machines and ("romance", "es", "fr") in model.machines
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    tested = [r for r in rows if held(r.doc_id)]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in tested)
    assert len(tested) > 200 and right >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = rows_of(spark, [None, "", "123 !? \n", "日本語", "é", rows[0].text * 50])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0) and found[3][0] in model.languages and found[5][0] == rows[0].lang
    assert language_id.predict(odd, None).where("lang_pred = 'und' and score = 0").count() == 6
    assert language_id.train(learn.limit(0)) is None and language_id.predict(odd.limit(0), model).count() == 0
    one = language_id.train(learn.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), one).collect()} == {"en"}


def test_language_sample_keeps_its_bounds(spark):
    """Repeated ids and rows don't enlarge the sample, null ids take part, and every language is learned."""
    rows = [(i % 3, f"text {i}", "en") for i in range(400)] + [(5, "the same", "de")] * 900 + [(None, f"null {i}", "fr") for i in range(4)] + [(i, "x", f"l{i:03}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in language_id.sample(docs, 100_000, 50).collect())
    assert got["en"] == got["de"] == 50 and got["fr"] == 4 and len(got) == 93
    assert set(Counter(r.lang for r in language_id.sample(docs, 100, 50).collect()).values()) == {1}  # one of each at least
    model = language_id.train(docs.where("lang like 'l00%'"))
    assert model.languages == [f"l{i:03}" for i in range(10)]


def test_language_votes_and_ties():
    """Families by margin, then votes, then sums of margins, then names: against a plain count."""
    languages, rnd = ["de", "en", "nl", "es", "fr", "xx"], np.random.default_rng(4)
    families = sorted({language_id.family(a) for a in languages})
    machines = [("family", f, None) for f in families] + [(f, a, b) for f in families for a, b in combinations([n for n in sorted(languages) if language_id.family(n) == f], 2)]
    model = language_id.Model(sorted(languages), machines, np.zeros((1, len(machines)), np.float32))
    margins = rnd.choice([-1.0, -0.5, 0.0, 0.5, 1.0], (500, len(machines)))  # many ties
    names, scores = model.decide(margins)
    sure = lambda m: 1 / (1 + np.exp(-2 * m))
    for row, name, score in zip(margins, names, scores, strict=True):
        value = {m: v for m, v in zip(machines, row.tolist(), strict=True)}
        best = max(families, key=lambda f: (value["family", f, None], -families.index(f)))
        members = [a for a in sorted(languages) if language_id.family(a) == best]
        votes, sums, shares = Counter(), Counter(), Counter()
        for (f, a, b), v in value.items():
            if f == best and b is not None:
                votes[a if v >= 0 else b] += 1
                sums[a] += v
                sums[b] -= v
                shares[a] += sure(v)
                shares[b] += 1 - sure(v)
        want = max(members, key=lambda a: (votes[a], sums[a], -members.index(a)))
        assert name == want
        assert score == pytest.approx(sure(value["family", best, None]) * (shares[want] / (len(members) - 1) if len(members) > 1 else 1))


def test_margins_are_means_of_weights(spark):
    """predict() against trigrams counted one by one."""
    docs = rows_of(spark, ["the cat and the dog", "le chat et le chien", "der Hund und die Katze", "Żółć i ość"] * 3)
    model = language_id.train(docs.select("doc_id", "text", F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "pl"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("lang")))
    bucket = language_id.bucket_of_gram()
    for text in ("the cat sat", "un chien", "Ö" * 50, "a"):
        symbols = [int(language_id._SYMBOLS[b]) for b in text.encode() + b"   "]
        grams = [(symbols[i] << 12) | (symbols[i + 1] << 6) | symbols[i + 2] for i in range(len(symbols) - 2)]
        grams = [g for g in grams if g]
        margins = sum(model.weights[bucket[g]].astype(np.float64) for g in grams) * language_id.SCALE / max(1, len(grams)) + model.weights[-1]
        names, scores = model.decide(margins[None, :])
        got = language_id.predict(rows_of(spark, [text]), model).head()
        assert got.lang_pred == names[0] and got.score == pytest.approx(float(scores[0]), abs=1e-4)


def test_pipeline_near_copies(spark, sf_dir):
    """The stage takes five words and 80 %, on pairs that four words and 85 % leave, and op5 keeps its contract's values."""
    import corpus_pipeline
    from docspring.llm import queries

    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").cache()
    rows = docs.select("doc_id", "text").collect()

    def components(size, percent):
        sets, at, top = {}, defaultdict(list), {r.doc_id: r.doc_id for r in rows}
        for r in rows:
            w = words((r.text or "").lower())
            sets[r.doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
            for x in sets[r.doc_id]:
                at[x].append(r.doc_id)

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for i, s in sets.items():
            for j, common in Counter(j for x in s for j in at[x] if j < i).items():
                if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
        return {i: find(i) for i in top}

    wide, thin = components(5, 80), components(4, 85)
    assert {i for i in wide if wide[i] == i} != {i for i in thin if thin[i] == i}
    assert {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, sf_dir).collect()} == {i for i in wide if wide[i] == i}
    got = queries.op5_jaccard_join(spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert {r.doc_id: r.component_id for r in got.collect()} == thin


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.common.stored(stage(spark, held, sf_dir), "test")
        assert held.columns == docs.columns and held.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert held.where("n_chars <> length(text)").count() == 0
        assert held.join(before, "doc_id", "left_anti").count() == 0
        before = held
    kept = {r.doc_id for r in held.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept and 0 < len(kept) < docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir) if "text" in empty.columns else empty
    assert empty.count() == 0


def test_language_id_bears_many_languages():
    """55 languages in 8 families: a slice of 2 MB needs no memory that grows with its bytes times the machines."""
    import tracemalloc

    names = [a for f in language_id.FAMILIES.values() for a in f.split()]
    rng = np.random.default_rng(1)
    x = (rng.random((len(names), language_id.BUCKETS)) < 0.01).astype(np.float32)
    model = language_id.Model.fit(x, names)
    assert len(model.machines) > 200
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefg hijklmno pqr", np.uint8), n)) for n in (1_200_000, *[400] * 2000)]
    bucket = language_id.bucket_of_gram().astype(np.int32)
    tracemalloc.start()
    got = [model.decide(m)[0] for _, _, m in model.margins(texts, bucket)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, got)) == 2001 and peak < 200e6, peak


def test_machines_are_at_their_optimum():
    """The fit against a plain descent on the same weighted hinge loss: the loss can't be lowered by much."""
    rng = np.random.default_rng(5)
    for seed in range(3):
        x = rng.normal(size=(60, 6)).astype(np.float32)
        y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) * 0.7 > 0.3, 1.0, -1.0)
        cost = 10.0
        weight = np.where(y > 0, cost * 60 / (2 * (y > 0).sum()), cost * 60 / (2 * (y < 0).sum()))
        norms = (x.astype(np.float64) ** 2).sum(axis=1) + 1

        def loss(w):
            return (w @ w) / 2 + (weight * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()

        got = loss(language_id.fit_machine(x, np.arange(60), y, norms, cost, rounds=400).astype(np.float64))
        w, best = np.zeros(7), np.inf
        with_one = np.hstack([x, np.ones((60, 1))])
        for t in range(1, 20_001):
            hit = y * (with_one @ w) < 1
            w = w - (w - ((weight * y)[hit, None] * with_one[hit]).sum(axis=0)) / (t + 10)
            best = min(best, loss(w))
        assert got < 1.02 * best
