"""Operators 4, 6, 8 and 10 against plain definitions."""

import base64
import copy
import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from docspring.llm import byte_bpe, exact_dedup, packing, queries, url_filters

P = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n\n", "a", "A", "tab\tend \n", "  two  spaces", "x" * 3000, "é ü z  q", "I'll it's\n\n\n b\n c", "<|endoftext|> </s>", "1234567 89\r\n\r\n9", "日本語 テキスト 🎉🎉", "a\x1cb \x1fc", "word, " * 500]


def documents(spark, texts, extra=True):
    rows = [(i, t, "x", i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, address string, group_size long, ids string")


def tiktoken_codec():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(spark, sf_dir):
    enc = tiktoken_codec()
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = ODD + real
    got = {r.doc_id: r for r in byte_bpe.encode_documents(documents(spark, texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[i].ids == want, (i, (t or "")[:80])
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert bytes(got[i].decoded) == (t or "").encode()


def test_prefix_table_appends_and_edits():
    enc, codec, rnd = tiktoken_codec(), byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(3)
    table, text = byte_bpe.PrefixTable(codec), b""
    for _ in range(60):
        more = rnd.choice([b"the", b"ing", b"zq", b"er", b"\xc3\xa9", b"tion"])
        table.append(more)
        text += more
        assert table.ids() == enc._core_bpe.encode_single_piece(text)
    for _ in range(60):
        lo = rnd.randrange(len(text))
        hi = min(len(text), lo + rnd.randrange(4))
        new = rnd.choice([b"", b"a", b"th"])
        text = text[:lo] + new + text[hi:]
        table.edit(lo, hi, new)
        assert table.ids() == enc._core_bpe.encode_single_piece(text)
    long = bytes(rnd.choice(b"abcdeth ing") for _ in range(5000))
    table = byte_bpe.PrefixTable(codec, long)
    made = table.edit(100, 103, b"zz")  # the entries behind the edit soon are the old ones again
    assert table.ids() == enc._core_bpe.encode_single_piece(long[:100] + b"zz" + long[103:]) and 2 < made < 500
    assert len(table.last) == 5000


def test_pairs_are_those_that_merges_leave():
    codec, rnd = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(8)

    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while found := [(codec.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in codec.ranks]:
            _, at = min(found)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    ids = list(codec.tokens)
    for _ in range(4000):
        a, b = rnd.choice(ids), rnd.choice([rnd.choice(ids), rnd.randrange(3000), rnd.randrange(256)])
        if rnd.random() < 0.2:
            b = a
        if b in codec.tokens:
            x, y = codec.tokens[a], codec.tokens[b]
            assert codec.pairs[a, b] == (merged(x + y) == [x, y])


def test_long_words_are_not_kept(spark):
    codec = byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = "a " + "xyz" * 5000 + " b"
    assert codec.encode_joined(text) == ",".join(map(str, tiktoken_codec().encode_ordinary(text)))
    encode = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(len(k) <= 64 for d in (codec.rest, codec.pieces, encode.rest) for k in d)


def test_packing_of_other_tokenizer_files(spark, tmp_path):
    """A file that isn't as the leaner engine assumes goes through the tokenizer whole."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    assert packing.is_plain(P.path("byte_bpe_50k.json"))
    for name, change in {"prefix": lambda x: x["pre_tokenizer"].update(add_prefix_space=True), "lower": lambda x: x.update(normalizer={"type": "Lowercase"}), "order": lambda x: x["model"]["merges"].reverse()}.items():
        other = copy.deepcopy(file)
        change(other)
        (tmp_path / f"{name}.json").write_text(json.dumps(other))
        encode = packing.Encoder(str(tmp_path / f"{name}.json"))
        assert not packing.is_plain(str(tmp_path / f"{name}.json"))
        for text in ("Some Words here", " and\nlines"):
            assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_covers_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["long word " * 5000]
    got = packing.pack_documents(documents(spark, texts), P.path("byte_bpe_50k.json")).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        rows = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in rows) == want
        assert all(r.doc_tokens == len(want) // 4 and r.length == len(r.ids) // 4 for r in rows)
    filled = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and rows[0].padded_length == (at if at & (at - 1) == 0 else 2048)
        filled += at
    assert filled > 0.97 * sum(rows[0].padded_length for rows in by_seq.values())


def test_best_fit_is_best_fit():
    rnd, fit, rooms = random.Random(1), packing.BestFit(2048), []
    for n in sorted((rnd.randrange(1, 2049) for _ in range(600)), reverse=True):
        want = min((room for room in rooms if room >= n), default=2048)
        which, offset = fit.put(n)
        assert 2048 - offset == want
        if which == len(rooms):
            rooms.append(2048)
        assert rooms[which] == want
        rooms[which] -= n


def test_emptiest_windows_are_dealt_out():
    lengths = [1500] * 9 + [100]
    placed = packing.pack(lengths)
    assert [sum(n for _, n, _, _ in x) for x in placed] == lengths
    assert len({w for x in placed for _, _, w, _ in x}) == 7
    assert packing.pack([]) == [] and packing.pack([2048, 1]) == [[(0, 2048, 0, 0)], [(0, 1, 1, 0)]]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("width", [32, 1])
def test_exact_dedup_brute_force(spark, keep, width):
    rnd = random.Random(5)
    texts = [rnd.choice(["Same", "same", "SAME ", "É", "é", None, "", "b" * 4000, "copy"]) for _ in range(300)] + ["copy"] * 700 + [f"t{i}" for i in range(300)]
    weak = (lambda b: hashlib.sha256(b).digest()[:1] * 16) if width == 1 else exact_dedup.sha256
    got = exact_dedup.exact_dedup(documents(spark, texts), keep, weak).collect()
    groups: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = {}
    for k, ids in groups.items():
        best = (max if keep == "max" else min)(ids)
        want |= {i: (best, len(ids), i == best, hashlib.sha256(k).hexdigest()) for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(texts)


def test_exact_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_index_levels():
    index, want = exact_dedup.Index(memtable=7, fan=2), {}
    rnd = random.Random(2)
    for i in range(500):
        k = bytes([rnd.randrange(40)]) * 15 + b"\0"
        index.add(k, 1000 - i)
        want[k] = (min(1000 - i, want.get(k, (9999, 0))[0]), want.get(k, (0, 0))[1] + 1)
    runs = index.runs()
    assert len(runs) < 12
    for k, (least, n) in want.items():
        at = [(r, r.find(np.array([k], "S16"))[0]) for r in runs]
        assert min(r.ids[j] for r, j in at if j >= 0) == least and sum(r.counts[j] for r, j in at if j >= 0) == n
    mixed = np.array([hashlib.md5(b"%d" % i).digest() for i in range(4000)], "S16")
    few = exact_dedup.Filter(mixed[:1000], 1 << 12)
    assert few.may_hold(mixed[:1000]).all() and len(few.packed) == 512 and exact_dedup.Filter.of(few.packed.tobytes()).may_hold(mixed[:1000]).all()
    assert exact_dedup.Filter(mixed[:1000]).may_hold(mixed[1000:]).mean() < 0.1
    assert exact_dedup.range_of(np.array([b"\xff" * 16, b"\x01\x00" + b"a" * 14], "S16")).tolist() == [exact_dedup.RANGES - 1, exact_dedup.RANGES // 256]
    absent = np.array([b"%016d" % i for i in range(50)], "S16")
    assert all((r.find(absent) == -1).all() for r in runs)


def test_urls_against_plain_rules(spark):
    rules = [*queries.URL_RULES, ("a.b.example.net/en/x", "block")]
    urls = ["http://x.net/", "http://x.net", "https://Example.NET/en/1?q#r", "http://sub.example.net/en", "http://a.b.example.net/en/xy", "http://example.com/de/1", "http://m.example.com/fr/", "https://q.org/fr/a#b", "ftp://net/", "nothing", None, "", "://net/x", "http://user@x.net:80/", "http://x.net?://y.net/", "a\nb://x.net/\n", "http://notnet/", "http://x.net//", "http://é.net/é"]

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
        path = next((rest[len(host) : i] for i in range(len(host), len(rest)) if rest[i] in "?#"), rest[len(host) :])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    want = {i: plain(u) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()} == want
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


def test_url_rules_of_any_characters_and_length(spark, monkeypatch):
    rules = [("x.net/é/", "block"), ("x.net/日本", "allow"), ("y.net/ab", "block"), ("b.y.net/", "allow"), ("X.net/É", "block"), ("x.net/é/", "allow"), ("İ.net/", "block")]
    urls = {"http://x.net/é/": "x.net/é/", "http://x.net/é/q": "x.net/é/", "http://x.net/日本語": "x.net/日本", "http://x.net/日": None, "http://b.y.net/ab": "b.y.net/", "http://y.net/abc": "y.net/ab", "http://x.net/Éa": "x.net/É", "http://İ.net/": "İ.net/", "http://x.net/" + "é" * 5000: None, "http://" + "x." * 300 + "net/é/" + "q" * 100_000: "x.net/é/"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdict = {"x.net/é/": "block", "x.net/日本": "allow", "y.net/ab": "block", "b.y.net/": "allow", "x.net/É": "block", "İ.net/": "block", None: "allow"}
    for most in (1_000_000, 2):  # one file, and several
        monkeypatch.setattr(url_filters.RuleFile.build, "__defaults__", (url_filters.RuleFile.build.__defaults__[0], most))
        got = {r.url: (r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()}
        assert got == {u: (r, verdict[r]) for u, r in urls.items()}
    assert url_filters.judge_urls(df, []).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_rule_file_survives_collisions(tmp_path):
    rules = [(f"h{i}.example/p{i}", "block" if i % 2 else "allow") for i in range(50)]
    weak = lambda b: len(b) % 3
    (tmp_path / "f").write_bytes(url_filters.RuleFile.build(rules, weak)[0])
    held = url_filters.RuleFile(str(tmp_path / "f"), weak)
    found = held.probe([r.encode() for r, _ in rules] + [b"h99.example/p1"])
    assert found[-1] == -1 and sorted(found[:-1].tolist()) == list(range(50))
    assert ["block" if held.verdicts[k] else "allow" for k in found[:-1]] == [v for _, v in rules]


def test_packing_crc(spark):
    got = packing.pack_documents(documents(spark, [None]), P.path("byte_bpe_50k.json")).collect()
    assert [(r.start, r.length, zlib.crc32(bytes(r.ids)), r.padded_length) for r in got] == [(0, 1, zlib.crc32(b"\1\0\0\0"), 1)]


def test_long_texts_and_empty_tables(spark):
    """Texts of megabytes beside short ones through operators 2, 4, 6, 8, 9 and 10, and tables without rows."""
    from docspring.llm import chat, language_id

    rnd = random.Random(2)
    long = " ".join(f"word{rnd.randrange(10**5)}" for _ in range(300_000))
    docs = spark.createDataFrame([(0, long), (1, "short"), (2, long), (3, None)], "doc_id long, text string").repartition(1)
    enc = tiktoken_codec()
    v = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r.ids_sha256 for r in byte_bpe.encode_documents(docs, v, P.PATTERN).select("doc_id", "ids_sha256").collect()}
    assert got[0] == got[2] == hashlib.sha256(",".join(map(str, enc.encode_ordinary(long))).encode()).hexdigest() and got[1] != got[3]
    assert byte_bpe.encode_documents(docs.limit(0), v, P.PATTERN).count() == 0
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    pieces = packing.pack_documents(docs, P.path("byte_bpe_50k.json"))
    assert pieces.agg({"doc_tokens": "max"}).head()[0] > 300_000 and packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    codec = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    row = chat.read_back(chat.format_turns(turns, *codec), *codec).head()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (3, len(long), hashlib.sha256(long.encode()).hexdigest())
    model = language_id.train(spark.createDataFrame([(i, f"some text {i}", "ab"[i % 2]) for i in range(8)], "doc_id long, text string, lang string"))
    assert language_id.predict(docs, model).where("lang_pred <> 'und'").count() == 3
    pages = spark.createDataFrame([(0, "http://a.example.net/en/" + "x" * 3_000_000)], "page_id long, url string")
    row = url_filters.judge_urls(pages, queries.URL_RULES).head()
    assert (row.rule, row.verdict, len(row.path)) == ("example.net/en/", "allow", 3_000_004) and url_filters.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_ranges_grow_with_the_table():
    assert [exact_dedup.ranges_for(n) for n in (0, 1, 256_000_000, 300_000_000, 10**10, 10**12)] == [256, 256, 256, 512, 16384, 65536]
