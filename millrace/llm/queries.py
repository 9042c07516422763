"""The numbered queries over the standard tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, media, minhash, mixing, packing, quality, repair, resampling, sharding, suffixes, warc
from .samples import fold
from .scratch import Scratch, bounded_batches, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words as the contracts define them, and A-Z lowered, in DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), k=4, percent=80)


ORACLE_SQL["op2_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""


@query
def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as hexadecimal digits, as DuckDB takes no substrings of binary values.
ORACLE_SQL["op8_suffixes"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), marked AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM again
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k
), edges AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM spans
  UNION ALL SELECT d.doc_id, d.n, coalesce(max(s.b), 0) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.n
), kept AS (
  SELECT d.doc_id, string_agg(substr(d.h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY kept_from) AS h FROM edges JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(sum(s.b - s.a), 0)::BIGINT AS n_removed, count(s.a)::BIGINT AS n_spans, sha256(unhex(any_value(k.h))) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.n
"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark), weights=(1, 2, 3), most=3, seed=0)
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE_SQL["op7_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), share AS (
  SELECT 0 AS k, sum(source_size)::BIGINT AS rest, sum(w)::BIGINT AS wt FROM s
  UNION ALL
  SELECT h.k + 1,
    (SELECT sum(source_size) FROM s)::BIGINT - 3 * (SELECT coalesce(sum(source_size), 0) FROM s WHERE NOT 3 * source_size * h.wt > h.rest * w)::BIGINT,
    (SELECT coalesce(sum(w), 0) FROM s WHERE 3 * source_size * h.wt > h.rest * w)::BIGINT
  FROM share h WHERE h.k < 100 AND h.wt > 0
), l AS (SELECT rest, wt FROM share ORDER BY k DESC LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN l.wt > 0 AND 3 * source_size * l.wt > l.rest * w THEN w::DOUBLE * l.rest::DOUBLE / l.wt::DOUBLE ELSE (3 * source_size)::DOUBLE END AS target
  FROM s, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INTEGER))::BIGINT AS taken
FROM r
"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark), k=5, threshold=0.8)


ORACLE_SQL["op6_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), dg AS (
  SELECT doc_id, ng, i - 1 AS p, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, greatest(len(ws) - 4, 1) AS ng, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), bg AS (
  SELECT item_id, greatest(len(ws) - 4, 1) AS nb, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), bc AS (SELECT item_id, nb, g, count(*) AS n FROM bg GROUP BY ALL),
starts AS (
  SELECT DISTINCT doc_id, item_id, nb, least(nb, ng) AS width, unnest(range(greatest(0, p - nb + 1), least(p, greatest(ng - nb, 0)) + 1)) AS s
  FROM dg JOIN bc USING (g)
), wc AS (
  SELECT t.doc_id, t.item_id, t.nb, t.width, t.s, dg.g, count(*) AS n
  FROM starts t JOIN dg ON dg.doc_id = t.doc_id AND dg.p BETWEEN t.s AND t.s + t.width - 1 GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, s, sum(least(wc.n, bc.n)) AS common, any_value(wc.nb + wc.width) AS sizes
  FROM wc JOIN bc USING (item_id, g) GROUP BY doc_id, item_id, s
), f AS (SELECT doc_id, item_id, s, common / (sizes - common) AS similarity FROM sim WHERE common / (sizes - common) >= 0.8)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_max(s, (similarity, -s))::BIGINT AS start_word, count(*)::BIGINT AS n_windows
FROM f GROUP BY doc_id, item_id
"""


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, folds=4, held=2))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return quality.scores(docs, model, threshold=0.3).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bounded_batches(spark, "16m")  # images are read side by side: more of them, and more of a size
    return media.describe(media.store_texts(docs))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), least=1000).drop("target_uri")


ORACLE_SQL["op1_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN m.first IS NULL OR m.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.first <> page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("""
        SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)
    """)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    scratch = Scratch(spark)
    done = scratch.keep(chat.render(chat.paths(chat.chains(rows), scratch, best=1)), "formatted")
    turn = F.struct("position", "role", "text")
    back = chat.parse(done).groupBy("tree").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    back = back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    sizes = done.select("tree", chat.masked("formatted", "loss_spans").alias("said"), F.length("formatted").cast("long").alias("formatted_chars"))
    both = back.join(sizes, back["conv_id"].eqNullSafe(sizes["tree"]))
    return both.select("conv_id", "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL["op3_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&#10;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 24 AS chars FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard(table(spark, sf_dir, "documents"), new_path(spark, "shards"), arrivals=8, target_bytes=128 << 20, fanout=4)
    text = F.coalesce("text", F.lit(""))
    return made.read().select("doc_id", "source", "arrival", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


ORACLE_SQL["op5_sharding"] = """
SELECT doc_id, source, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8)::INTEGER AS arrival,
  strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, Scratch(spark), buckets=10_000, percent=5, least_words=20, seed=42)



# The CRC-32 of a run of words is made of those of its words: that of what comes before is taken on by as
# many zero bytes as the next word has. 3916222277 is the CRC-32 of a space.
ORACLE_SQL["op12_resampling"] = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) t(n)
), given AS (
  SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT part, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM given
), places AS (
  SELECT part, id, r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), bytes AS (
  SELECT word, hex(encode(word)) AS h, strlen(word) AS n FROM (SELECT DISTINCT word FROM places)
), crcs AS (
  SELECT word, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM bytes, tab
), one AS (
  SELECT part, id, r, i, n, crc FROM places JOIN crcs USING (word)
), two AS (
  SELECT a.part, a.id, a.r, b.i, b.n, b.crc AS own, xor(list_reduce(list_prepend(xor(xor(a.crc >> 8, tab[(a.crc & 255) + 1]), 3916222277), range(b.n)), lambda c, k: xor(c >> 8, tab[(c & 255) + 1])), b.crc) AS crc
  FROM one a JOIN one b ON b.r = a.r AND b.i = a.i + 1, tab
), three AS (
  SELECT a.part, a.id, a.r, b.i, xor(list_reduce(list_prepend(xor(xor(a.crc >> 8, tab[(a.crc & 255) + 1]), 3916222277), range(b.n)), lambda c, k: xor(c >> 8, tab[(c & 255) + 1])), b.crc) AS crc
  FROM two a JOIN one b ON b.r = a.r AND b.i = a.i + 1, tab
), f AS (
  SELECT part, id, r, crc % 10000 AS bucket FROM one UNION ALL SELECT part, id, r, crc % 10000 FROM two UNION ALL SELECT part, id, r, crc % 10000 FROM three
), total AS (SELECT count(*) FILTER (WHERE part = 0)::DOUBLE AS s, count(*) FILTER (WHERE part = 1)::DOUBLE AS t FROM f
), gain AS (
  SELECT bucket, floor(1000 * ln((count(*) FILTER (WHERE part = 1) + 1)::DOUBLE * (any_value(total.s) + 10000) / ((count(*) FILTER (WHERE part = 0) + 1)::DOUBLE * (any_value(total.t) + 10000))))::BIGINT AS gain FROM f, total GROUP BY bucket
), sums AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE part = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, r, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN sums USING (r) WHERE part = 0
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scratch = table(spark, sf_dir, "conversations"), Scratch(spark)
    summary, lines = repair.repair(repair.damaged(rows), scratch)
    sha = repair.digests(lines).withColumnRenamed("conv_id", "conv_")
    found = summary.withColumnRenamed("conv_id", "of")
    convs = rows.select("conv_id").distinct()
    out = convs.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("conv_")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# The edits of a turn, with up to three inserts behind them, are rows of `move`; the recursion keeps the
# least (cost, audit) for each state, with the text it makes.
ORACLE_SQL["op13_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) t(n)
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), crcs AS (
  SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM (SELECT DISTINCT key FROM k), tab
), dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k JOIN crcs USING (key) WHERE d <> 0
), num AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam
), f AS (
  SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM num
), edit(i, j, ini, edit, cost) AS (
  SELECT i, i, NULL::VARCHAR, 'D', 2 FROM range(4) t(i) UNION ALL
  SELECT i, CASE WHEN i = 2 THEN 3 ELSE 2 END, NULL::VARCHAR, 'R', 1 FROM range(4) t(i) UNION ALL
  VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0)
), ins AS (
  SELECT i, i AS j, 0 AS n, '' AS said FROM range(4) t(i) UNION ALL
  SELECT i, CASE WHEN j = 2 THEN 3 ELSE 2 END, n + 1, said || CASE WHEN j = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END FROM ins WHERE n < 3
), move AS (
  SELECT e.i, n.j, e.j AS mid, e.ini, e.edit, e.cost + 5 * n.n AS cost, e.edit || repeat('I', n.n) AS audit, n.said FROM edit e JOIN ins n ON n.i = e.j
), r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, n.j AS state, {'c': 5 * n.n, 'a': repeat('I', n.n), 't': n.said} AS b FROM f, (SELECT j, n, said FROM ins WHERE i = 0) n
  UNION ALL
  SELECT r.conv_id, f.pos, m.j, min({'c': r.b.c + m.cost + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'a': r.b.a || m.audit,
    't': r.b.t || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE WHEN m.mid = 3 THEN 'assistant:' ELSE 'user:' END || f.text END || m.said})
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1
  JOIN move m ON m.i = r.state AND (m.ini IS NULL OR m.ini = f.ini) AND (m.edit = 'D' OR f.fault IN ('', 'truncated'))
  GROUP BY r.conv_id, f.pos, m.j
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pos > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id
), done AS (
  SELECT s.conv_id, min(r.b) AS b FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.n WHERE r.state IN (0, 3) GROUP BY s.conv_id
)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(done.b.c, 0)::BIGINT AS cost, coalesce(done.b.a, '') AS audit, sha256(coalesce(substr(done.b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
