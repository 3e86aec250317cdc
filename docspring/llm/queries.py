"""One query for each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.llm import byte_bpe, chat, common, exact_dedup, jaccard_join, language_id, line_dedup, packing, pii, quality, repair, spelling, substring_dedup, url_filters

#: The rules of the contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("__kept_words", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    v, p = vocabulary("byte_bpe_50k.tiktoken"), split_pattern()
    return chat.read_back(chat.format_turns(rows.unionByName(more), v, p), v, p)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_limited_words")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.documents(spark, sf_dir), keep="max")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(common.documents(spark, sf_dir), percent=85, shingle=4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(common.documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(docs.doc_id.cast("string"), F.lit(""))) % 4 == 2
    model = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.judge_urls(pages, URL_RULES).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_formatting, op3_quality_rules, op4_exact_dedup, op5_jaccard_join, op6_packing, op7_line_dedup, op8_byte_bpe, op9_language_id, op10_url_filters, op11_pii, op12_spelling_variants, op13_conversation_repair)}

SPACES = r"\x20\x09-\x0D"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The table of the common checksum of 32 bits, and the checksum of a text by it.
CRC_TABLE = """t0 AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
        tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t0 WHERE k = 8)"""


def crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def repair_step() -> tuple[str, str]:
    """Columns of a step of the repair: the states after inserts (pn, ps, pu, pa), then after the row. A state is a struct of
    cost, audit and text, whose order is that of cost, then audit."""
    put = lambda x, cost, letters, text="''": f"{{'c': {x}.c + {cost}, 'w': {x}.w || '{letters}', 't': {x}.t || {text}}}"
    first = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    user, answer = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    both = f"{user} || {answer}"
    pu = first("u", *(put(x, 3, "I", user) for x in "nsa"), put("u", 6, "II", f"{answer} || {user}"))
    pa = first("a", put("u", 3, "I", answer), *(put(x, 6, "II", both) for x in "nsa"))
    no = "{'c': 1000000, 'w': '', 't': ''}"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {no} END"
    own = "chr(10) || role || ':' || text"
    drop = lambda x: put(x, 4, "D")
    keep = lambda letter, x: when(f"NOT doomed AND letter = '{letter}'", put(x, "tr", "K", own))
    turn = lambda x, role: when("NOT doomed", put(x, "3 + tr", "R", f"{role} || text"))
    after = [
        f"{drop('n')} AS n", first(drop("s"), keep("s", "n")) + " AS s",
        first(drop("pu"), *(keep("u", x) for x in ("n", "s", "pa")), *(turn(x, user) for x in ("n", "s", "pa"))) + " AS u",
        first(drop("pa"), keep("a", "pu"), turn("pu", answer)) + " AS a",
    ]
    return f"{pu} AS pu, {pa} AS pa", ", ".join(after)


ORACLE_SQL = {
    "op12_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        r AS (SELECT doc_id, {LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}'))")} AS run FROM documents),
        d AS (SELECT run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS said FROM r GROUP BY doc_id, run),
        h AS (SELECT run, c, {crc("said")} AS h FROM d, tab),
        m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
        w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
        put AS (SELECT DISTINCT v.word AS long, v.n AS long_n, w.word AS short, w.n AS short_n FROM v JOIN w ON v.rest = w.word),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                 UNION ALL SELECT long, short, short_n FROM put UNION ALL SELECT short, long, long_n FROM put),
        best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
        f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
        walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
        tops AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN tops ON tops.word = f.word""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE {CRC_TABLE},
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations),
        h AS (SELECT src.*, {crc("said")} % 20 AS h FROM src, tab),
        dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
        g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        k AS MATERIALIZED (SELECT conv_id, turn, i, role, text, letter, before, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM g),
        z AS (SELECT conv_id, i, role, text, letter, blank OR duplicate AS doomed, CASE WHEN truncated THEN 3 ELSE 0 END AS tr FROM k),
        no AS (SELECT {{'c': 1000000, 'w': '', 't': ''}} AS x),
        dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'w': '', 't': ''}} AS n, x AS s, x AS u, x AS a FROM (SELECT DISTINCT conv_id FROM conversations), no
               UNION ALL SELECT conv_id, i, {repair_step()[1]} FROM (SELECT dp.conv_id, z.i, role, text, letter, doomed, tr, n, s, u, a, {repair_step()[0]} FROM dp JOIN z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.i = dp.i + 1)),
        ends AS (SELECT conv_id, list_sort([n, a, {{'c': u.c + 3, 'w': u.w || 'I', 't': u.t || chr(10) || 'assistant:'}}, {{'c': s.c + 6, 'w': s.w || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}])[1] AS x FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c::BIGINT AS cost, x.w AS audit, sha256(substr(x.t, 2)) AS repaired_sha256
        FROM ends e LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS normal FROM documents),
        k AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY normal) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size, sha256(normal) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k""",
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY sha256(array_to_string(words[i:i+34], ' '))) AS n FROM starts),
        edges AS (SELECT doc_id, i, 1 AS step FROM windows WHERE n > 1 UNION ALL SELECT doc_id, i + 35, -1 FROM windows WHERE n > 1),
        steps AS (SELECT doc_id, i, sum(step) AS step FROM edges GROUP BY doc_id, i),
        depth AS (SELECT w.doc_id, w.i, word, sum(coalesce(step, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS deep FROM w LEFT JOIN steps ON w.doc_id = steps.doc_id AND w.i = steps.i),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (deep = 0) AS kept, count(*) FILTER (deep > 0) AS n_removed FROM depth GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op5_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^{SPACES}]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
        e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS top FROM d UNION SELECT e.x, r.top FROM r JOIN e ON e.y = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(top) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS words FROM documents),
        lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
        full_lines AS (SELECT *, translate({LOWER.format("trim(regexp_replace(line, '[" + SPACES + "]+', ' ', 'g'))")}, '123456789', '000000000') AS normal, len(regexp_extract_all(line, '[^{SPACES}]+')) AS line_words FROM lines WHERE regexp_matches(line, '[^{SPACES}]')),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+7], ' ')) AS n FROM starts),
        reps AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(8) AS r(k) WHERE n > 1 GROUP BY doc_id),
        hosts AS (SELECT host, count(DISTINCT text) AS host_texts FROM d GROUP BY host),
        above AS (SELECT host, normal FROM full_lines JOIN hosts USING (host) GROUP BY host, normal HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.1 * any_value(host_texts)),
        limited AS (SELECT doc_id, sum(line_words)::BIGINT AS n_limited_words FROM full_lines JOIN above USING (host, normal) GROUP BY doc_id),
        m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[{SPACES}]+', '', 'g')) AS word_chars,
                     length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_limited_words, 0) AS n_limited_words
              FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN limited USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_limited_words,
               NOT base_failed AND n_words - n_limited_words >= 20 AND n_words - n_limited_words >= 0.5 * n_words AS kept FROM b""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
        f AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM l WHERE trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
        r AS (SELECT doc_id, line, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3, body || chr(10) || lead(body) OVER w || chr(10) || lead(body, 2) OVER w AS run FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
        p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, line) AS place FROM r WHERE run IS NOT NULL),
        gone AS (SELECT doc_id, line FROM p WHERE place > 1 UNION SELECT doc_id, line2 FROM p WHERE place > 1 UNION SELECT doc_id, line3 FROM p WHERE place > 1)
        SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed, sha256(coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY l.doc_id""",
    "op10_url_filters": f"""
        WITH s AS (SELECT page_id, strpos(url, '://') AS pos, url FROM pages),
        r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM s),
        h AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
        rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        m AS (SELECT page_id, host, path, rule, rule_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
              FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE n = 1""",
}
