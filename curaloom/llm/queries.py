"""The registered queries of this package and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, exact_dedup, html_text, ngram_lm, packing, pii, quality, secrets, sharding, simhash, spelling, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(found["id"].alias("doc_id"), "fingerprint", "component_id")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_records(index, index.schema["id"].dataType.simpleString(), with_payload=False)
    return found.select(found["id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("found")


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    return secrets.digest(found).withColumnRenamed("id", "doc_id")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "verbatim", "template", F.round("share", 6).alias("share"))


def tokenizer_files() -> dict[str, str]:
    """Where the public vocabulary lies: its file, the same as ranks, and its pattern."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())
    return found.withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(found["id"].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("tokens") > 0, F.col("log_score") / F.col("tokens")).otherwise(0.0)
    return found.select(F.col("id").alias("doc_id"), "tokens", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents"), drop_one_in=31))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def crc32_sql(octets: str) -> str:
    """SQL for the CRC-32 of a list of octets; the table of remainders is worked out here."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({octets} AS BIGINT[])), lambda a, b: xor(CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def sharding_sql(shards: int = 40, one_in: int = 100) -> str:
    """Cells of keys at every number of digits; of each splitter the first cell whose nearer edge is near enough."""
    octets = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    told = [d for d in sharding.ROUNDS if d <= 2 * sharding.PART]  # ids of the tables differ
    return f"""
        WITH k AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + {sharding.OVERHEAD} AS BIGINT) AS size, {crc32_sql(octets)} AS text_crc32,
                          substr(md5(coalesce(text, '')), 1, {sharding.PART}) || substr(md5(CAST(doc_id AS VARCHAR)), 1, {sharding.PART}) AS key FROM documents),
        o AS (SELECT *, CAST(sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS below FROM k),
        t AS (SELECT nth, (total * nth) // {shards} AS target, total // {one_in * shards} AS slack FROM range(1, {shards}) r(nth), (SELECT CAST(sum(size) AS BIGINT) AS total FROM k)),
        c AS (SELECT digits, substr(key, 1, digits) AS cell, min(below) AS lower, max(below + size) AS upper FROM o, (SELECT unnest({told}) AS digits) GROUP BY ALL),
        h AS (SELECT nth, digits, lower, upper, target - lower AS down, upper - target AS up, slack FROM t JOIN c ON lower < target AND target <= upper),
        b AS (SELECT nth, arg_min(CASE WHEN down <= up THEN lower ELSE upper END, digits) AS cut FROM h WHERE least(down, up) <= slack OR digits = {told[-1]} GROUP BY nth UNION ALL SELECT nth, 0 FROM t WHERE target = 0),
        s AS (SELECT o.*, (SELECT count(*) FROM b WHERE cut <= below) AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
    """


def spelling_sql(least: int = 7, times: int = 10, drop_one_in: int = 31) -> str:
    """Near words meet on what remains when a letter is deleted, at the same place or from one of the two."""
    octets = "flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"""
        WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.LETTERS}+')), '{spelling.CAPITALS}', '{spelling.CAPITALS.lower()}') AS w FROM documents),
        q AS (SELECT w, {crc32_sql(octets)} AS h FROM r WHERE length(w) >= {least}),
        z AS (SELECT CASE WHEN h % {drop_one_in} = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w FROM q),
        v AS (SELECT w, count(*) AS n FROM z WHERE length(w) >= {least} GROUP BY w HAVING count(*) >= 2),
        d AS (SELECT w, n, p, substr(w, 1, p - 1) || substr(w, p + 1) AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS p FROM v)),
        x AS (SELECT a.w AS w, b.w AS o, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.w <> b.w UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.rest = v.w UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.rest = v.w),
        g AS (SELECT w, count(*) AS k, max(m) AS m FROM x GROUP BY w),
        e AS (SELECT v.w, v.n, coalesce(k, 0) AS k, CASE WHEN g.m >= {times} * v.n THEN g.m END AS m FROM v LEFT JOIN g USING (w)),
        f AS (SELECT e.w, e.n, e.k, e.m, (SELECT min(encode(o)) FROM x WHERE x.w = e.w AND x.m = e.m) AS f FROM e),
        s AS (SELECT w, n, k, m, decode(f) AS f FROM f),
        c AS (SELECT w, w AS at, f AS onward FROM s UNION ALL SELECT c.w, s.w, s.f FROM c JOIN s ON c.onward = s.w)
        SELECT s.w AS word, s.f AS form, c.at AS root, n, k AS n_near, m AS form_n FROM s JOIN c ON c.w = s.w AND c.onward IS NULL
    """


def audit_sql() -> str:
    """Every order is applied step by step to the counts of documents by what they fail."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(audit.FILTERS))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
        f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM d LEFT JOIN g USING (doc_id)),
        h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
        l(f, bit) AS (VALUES {letters}),
        p AS (SELECT a.f || b.f || c.f || e.f || i.f AS o, [a.bit, b.bit, c.bit, e.bit, i.bit] AS bits FROM l a, l b, l c, l e, l i WHERE a.bit + b.bit + c.bit + e.bit + i.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, e.bit, i.bit])) = 5),
        s AS (SELECT o, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS earlier FROM p, range(1, 6) r(step)),
        t AS (SELECT part, o, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS redundant,
                     coalesce(sum(n) FILTER (mask = bit), 0) AS alone, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS good, coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS bad FROM h, s GROUP BY ALL)
        SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails,
               CAST(good AS BIGINT) AS good_lost, CAST(bad AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t
    """


def secrets_sql() -> str:
    """The scan in SQL: the same patterns, places by sums over the text between matches."""
    kinds = []
    for nth, (kind, pattern, group, least) in enumerate(secrets.BASE + secrets.WIDE):
        quoted = pattern.replace("'", "''")
        opaque = "AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if kind == "opaque" else ""
        kinds.append(f"""
            SELECT row_no, {nth} AS nth, '{kind}' AS kind, {nth >= len(secrets.BASE)} AS wide, owner, repo, v, s, s + length(m) AS e FROM (
                SELECT row_no, owner, repo, ms[i] AS m, vs[i] AS v,
                       coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS s
                FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
                    SELECT row_no, owner, repo, regexp_extract_all(x, '{quoted}', 0) AS ms, regexp_extract_all(x, '{quoted}', {group}) AS vs, string_split_regex(x, '{quoted}') AS gs FROM t))
            ) WHERE length(v) >= {least} {opaque}""")
    union = " UNION ALL ".join(kinds)
    return f"""
        WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS x, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
        c AS ({union}),
        o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM c GROUP BY v),
        k AS (SELECT c.*, owners, repos, owners <= 1 AND repos <= 3 AS live FROM c JOIN o USING (v)),
        f AS (SELECT * FROM k WHERE NOT wide OR (live AND NOT EXISTS (SELECT 1 FROM k AS b WHERE b.row_no = k.row_no AND NOT b.wide AND b.s < k.e AND k.s < b.e))),
        g AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (live) AS l, max(owners) AS mo, max(repos) AS mr,
                     string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, nth) AS al,
                     string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, nth) FILTER (NOT wide) AS ba FROM f GROUP BY row_no)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, coalesce(l, 0) AS n_live, coalesce(mo, 0) AS most_owners, coalesce(mr, 0) AS most_repos,
               sha256(coalesce(ba, '')) AS base_sha256, coalesce(al, '') AS spans
        FROM t LEFT JOIN g USING (row_no)
    """


def templates_sql() -> str:
    """Readings, windows, alignments and slots as relations of words; keys are the joined words themselves."""
    numbers, units = decontaminate.quoted(decontaminate.NUMBER_WORDS), decontaminate.quoted(decontaminate.UNITS)

    def side(of: str, table_name: str, key: str) -> str:
        return rf"""
            {of}w AS (SELECT {key} AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{decontaminate.UNSPACED}]\p{{M}}*)', ' \1 ', 'g'), '[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,:/][0-9]+)*') AS ws FROM {table_name})),
            {of}num AS (SELECT *, lower(w) AS l, regexp_matches(w, '^[0-9]') OR lower(w) IN ({numbers}) AS num FROM {of}w),
            {of}k AS (SELECT *, CASE WHEN num THEN '#number' WHEN lag(num) OVER o AND l IN ({units}) THEN '#unit'
                                     WHEN length(w) > 1 AND w <> l AND substr(w, 2) = lower(substr(w, 2)) THEN '#name' ELSE '' END AS k FROM {of}num WINDOW o AS (PARTITION BY id ORDER BY i)),
            {of}c AS (SELECT *, CASE WHEN k <> '' AND k = lag(k) OVER o AND (k = '#name' OR (k = '#number' AND NOT regexp_matches(w, '^[0-9]'))) THEN 0 ELSE 1 END AS starts FROM {of}k WINDOW o AS (PARTITION BY id ORDER BY i)),
            {of}r AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS run FROM {of}c),
            {of}e AS (
                SELECT id, 'words' AS way, i, l AS t, NULL AS v FROM {of}r
                UNION ALL SELECT id, 'values', i, CASE WHEN k IN ('#number', '#unit') THEN k ELSE l END, CASE WHEN k IN ('#number', '#unit') THEN l END FROM {of}r
                UNION ALL SELECT id, 'names', run, CASE WHEN min(k) = '' THEN min(l) ELSE min(k) END, CASE WHEN min(k) <> '' THEN string_agg(l, ' ' ORDER BY i) END FROM {of}r GROUP BY id, run),
            {of}l AS (SELECT id, way, list(t ORDER BY i) AS ts, list(v ORDER BY i) AS vs FROM {of}e GROUP BY id, way)"""

    return f"""
        WITH {side('d', 'documents', 'doc_id')}, {side('i', 'benchmark', 'item_id')},
        s1 AS (SELECT *, len(ts) AS n, least(len(ts), 8) AS width FROM il),
        s2 AS (SELECT id, way, ts, vs, n, width, unnest(range(1, n - width + 2)) AS pos FROM s1),
        s AS (SELECT id AS item_id, way, n, width, pos, ts[pos:pos + width - 1] AS key, vs[pos:pos + width - 1] AS own FROM s2 WHERE way = 'words' OR len(list_filter(ts[pos:pos + width - 1], lambda t: NOT starts_with(t, '#'))) > 0),
        d1 AS (SELECT id, way, ts, vs, width, unnest(range(1, len(ts) - width + 2)) AS pos FROM dl, (SELECT DISTINCT width FROM s1) WHERE len(ts) >= width),
        d AS (SELECT id, way, pos, ts[pos:pos + width - 1] AS key, vs[pos:pos + width - 1] AS seen FROM d1),
        h AS (SELECT d.id, s.item_id, s.way, n, width, s.pos, s.key, d.pos - s.pos AS shift, own, seen FROM d JOIN s ON d.way = s.way AND d.key = s.key),
        q AS (SELECT id, item_id, way, shift, unnest(own) AS o, unnest(seen) AS e FROM h),
        bad AS (SELECT DISTINCT id, item_id, way, shift FROM q WHERE o IS NOT NULL GROUP BY id, item_id, way, shift, o HAVING count(DISTINCT e) > 1),
        ok AS (SELECT h.*, unnest(range(h.pos, h.pos + width)) AS place, unnest(h.key) AS t FROM h LEFT JOIN bad USING (id, item_id, way, shift) WHERE bad.id IS NULL OR own IS NOT DISTINCT FROM seen),
        c AS (SELECT id, item_id, way, n, count(DISTINCT place) AS c, count(DISTINCT CASE WHEN NOT starts_with(t, '#') THEN t END) AS p FROM ok GROUP BY id, item_id, way, n)
        SELECT id AS doc_id, item_id, coalesce(max(c) FILTER (way = 'words'), 0) AS verbatim, coalesce(max(c) FILTER (way <> 'words'), 0) AS template, round(max(c / n), 6) AS share
        FROM c GROUP BY id, item_id HAVING bool_or(way = 'words' OR c * least(p, 4) >= 64 OR (p >= 4 AND 2 * c >= n) OR (c = n AND n >= 4))
    """


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality_ftrl": op2_quality_ftrl,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_warc_index": op4_warc_index,
    "op5_pii_semi_markov": op5_pii_semi_markov,
    "op6_secret_ownership": op6_secret_ownership,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_stupid_backoff": op10_stupid_backoff,
    "op11_histogram_sort": op11_histogram_sort,
    "op12_anagram_variants": op12_anagram_variants,
    "op13_filter_audit": op13_filter_audit,
}

LM_SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
    ), w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
    g AS (
        SELECT r, i, w AS g1, CASE WHEN i > 1 THEN concat_ws(' ', lag(w) OVER o, w) END AS g2, CASE WHEN i > 2 THEN concat_ws(' ', lag(w, 2) OVER o, lag(w) OVER o, w) END AS g3
        FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
    ),
    n1 AS (SELECT r, g1, count(*) AS own, sum(count(*)) OVER (PARTITION BY g1) AS al FROM g GROUP BY r, g1),
    n2 AS (SELECT r, g2, count(*) AS own, sum(count(*)) OVER (PARTITION BY g2) AS al FROM g WHERE g2 IS NOT NULL GROUP BY r, g2),
    n3 AS (SELECT r, g3, count(*) AS own, sum(count(*)) OVER (PARTITION BY g3) AS al FROM g WHERE g3 IS NOT NULL GROUP BY r, g3),
    c AS (
        SELECT g.r, i, n1.al - n1.own AS c1, coalesce(n2.al - n2.own, 0) AS c2, coalesce(n3.al - n3.own, 0) AS c3
        FROM g JOIN n1 ON g.r = n1.r AND g.g1 = n1.g1 LEFT JOIN n2 ON g.r = n2.r AND g.g2 = n2.g2 LEFT JOIN n3 ON g.r = n3.r AND g.g3 = n3.g3
    ),
    h AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
    t AS (SELECT r, count(*) AS n, greatest(sum(count(*)) OVER () - count(*), 1) AS rest FROM w GROUP BY r),
    s AS (
        SELECT h.r, sum(CASE WHEN c3 > 0 THEN ln(c3) - ln(p2)
                             WHEN c2 > 0 THEN ln(c2) - ln(p1) + (least(i, 3) - 2) * ln(0.4)
                             WHEN c1 > 0 THEN ln(c1) - ln(rest) + (least(i, 3) - 1) * ln(0.4)
                             ELSE least(i, 3) * ln(0.4) - ln(rest) END) AS log_score, any_value(n) AS n
        FROM h JOIN t ON h.r = t.r GROUP BY h.r
    )
    SELECT doc_id, coalesce(n, 0) AS tokens, round(coalesce(log_score, 0), 4) AS log_score, round(coalesce(log_score / n, 0), 6) AS mean_log_score
    FROM d LEFT JOIN s ON d.r = s.r
"""

ORACLE_SQL = {
    "op10_stupid_backoff": LM_SQL,
    "op11_histogram_sort": sharding_sql(),
    "op12_anagram_variants": spelling_sql(),
    "op13_filter_audit": audit_sql(),
    "op4_warc_index": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
        q AS (SELECT page_id, x, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS chosen FROM p)
        SELECT page_id, octet_length(encode(x)) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> chosen THEN chosen END AS refers_to
        FROM q
    """,
    "op6_secret_ownership": secrets_sql(),
    "op7_template_decontamination": templates_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
        ), g AS (
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(x) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY n) AS group_size, n
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
    """,
}
