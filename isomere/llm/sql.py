"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

#: Each source's target by filling up to twice its size, then blocks by highest
#: quotients: every seat of every party is listed, unlike in the query.
MIXING = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS w, 2 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)::BIGINT) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS level, cap / w::DOUBLE AS ratio FROM w WINDOW o AS (ORDER BY cap / w::DOUBLE, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ratio <= level AS full_ FROM l),
t AS (SELECT source, sid, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE w * ((total * 1.5::DOUBLE - coalesce(sum(cap) FILTER (full_) OVER (), 0)::BIGINT) / (sum(w) OVER () - coalesce(sum(w) FILTER (full_) OVER (), 0))::BIGINT) END AS target,
        floor(total * 1.5::DOUBLE / 16 + 0.5)::BIGINT AS blocks, CASE WHEN source_size <= 32768 THEN 1 ELSE least(16384, (2.0::DOUBLE ** length(bin((source_size - 1) // 32768)))::BIGINT) END AS shards FROM f),
q1 AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, sid, k) AS rank, blocks FROM t, range(1, (SELECT max(blocks) + 2 FROM t)) r(k) WHERE target > 0 AND k <= target / 16 + 40),
quota AS (SELECT sid, count(*) AS quota FROM q1 WHERE rank <= blocks GROUP BY sid),
p AS (SELECT d.*, t.sid, t.source_size, t.target, (('0x' || substr(place, 1, 8))::BIGINT % 16384) % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT sid, shard, any_value(source) AS name, sum(size)::BIGINT AS words FROM p GROUP BY sid, shard),
q2 AS (SELECT h.sid, shard, row_number() OVER (PARTITION BY h.sid ORDER BY words / (2 * k - 1)::DOUBLE DESC, shard, k) AS rank, quota FROM h JOIN quota USING (sid), range(1, (SELECT max(words) // 8 + 42 FROM h)) r(k) WHERE words > 0 AND k <= words / 8 + 40),
shard_quota AS (SELECT sid, shard, count(*) AS q FROM q2 WHERE rank <= quota GROUP BY ALL),
b AS (SELECT h.sid, h.shard, (words + 15) // 16 AS nb, least(coalesce(q, 0), 2 * ((words + 15) // 16)) AS q, ('0x' || substr(md5('mix-1/' || coalesce(name, '') || '/' || shard), 1, 8))::BIGINT AS seed FROM h LEFT JOIN shard_quota USING (sid, shard)),
c AS (SELECT sid, shard, greatest(nb, 1) AS nb, CASE WHEN nb > 0 THEN q // nb ELSE 0 END AS base, CASE WHEN nb > 0 THEN q % nb ELSE 0 END AS r, seed % greatest(nb, 1) AS o FROM b),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM p),
x AS (SELECT a.*, c.*, lo + size AS hi FROM a JOIN c USING (sid, shard)),
g AS (SELECT *, 16 * ((hi // 16 * r + o) // nb) + hi % 16 * (((hi // 16 + 1) * r + o) // nb - (hi // 16 * r + o) // nb) - 16 * ((lo // 16 * r + o) // nb) - lo % 16 * (((lo // 16 + 1) * r + o) // nb - (lo // 16 * r + o) // nb) AS extra FROM x)
SELECT doc_id, size, source_size, target, CAST(base * size + extra AS BIGINT) AS taken FROM g
"""

#: Cosines of all pairs of a label, components by reachability.
EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

#: Windows by prefix sums over whole conversations, without the sections of the query.
CHAT = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
        '<|im_start|>' || replace(replace(role, '<|', '<||'), chr(10), '<|n|>') || chr(10) || replace(text, '<|', '<||') || '<|im_end|>' || chr(10) AS shown, length(replace(text, '<|', '<||')) // 4 + 4 AS tokens FROM r),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        sum(CASE WHEN tokens > 256 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT AS longs FROM t),
w AS (SELECT *, CASE WHEN tokens > 256 THEN longs || ' long' ELSE longs || ' ' || (before // 256) END AS w FROM b),
n AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(before, 1) OVER o AS b1, lead(before, 2) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, w, shown FROM n UNION ALL SELECT conv_id, w1, shown FROM n WHERE w1 <> w AND b1 - before <= 256 UNION ALL SELECT conv_id, w2, shown FROM n WHERE w2 <> w1 AND b2 - before <= 256),
s AS (SELECT conv_id, shown AS first_shown FROM t WHERE pos = 1 AND role = 'system'),
f AS (SELECT m.conv_id, m.w, sum(length(shown)) + coalesce(max(length(first_shown)), 0) * CASE WHEN bool_or(coalesce(shown = first_shown, TRUE)) THEN 0 ELSE 1 END AS size
    FROM m LEFT JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY m.conv_id, m.w),
z AS (SELECT conv_id, sum(size)::BIGINT AS formatted_chars FROM f GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS lost FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM d JOIN z ON d.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLES: dict[str, str] = {"op1_mixing": MIXING, "op5_chat": CHAT, "op6_embed_dedup": EMBEDDINGS}
