"""DuckDB SQL for the queries, written from the definitions and not from the Spark plans."""
from __future__ import annotations

from .views import GENES_SQL, READS_SQL, SAMPLES_SQL

P = 'contig, strand, start, "end"'
OV = "greatest(0, least({0}e, {1}e) - greatest({0}s, {1}s))"


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"


READS = f"reads AS ({READS_SQL})"
GENES = f"genes AS ({GENES_SQL})"
SAMPLES = f"samples AS ({SAMPLES_SQL})"
DI = f'di AS (SELECT {P}, count(*) AS n_reads, min(id) AS id, row_number() OVER (ORDER BY {P}) AS nid FROM reads GROUP BY {P})'


def _bp(a: str, b: str) -> str:
    return f'greatest(0, least({a}."end", {b}."end") - greatest({a}.start, {b}.start))'


def _score1(a: str, b: str) -> str:
    return f'(CAST({_bp(a, b)} AS DOUBLE) / (({a}."end" - {a}.start) + ({b}."end" - {b}.start) - {_bp(a, b)}))'


def _score2(a: str, b: str) -> str:
    return f'(CAST({_bp(a, b)} AS DOUBLE) / greatest({a}."end" - {a}.start, {b}."end" - {b}.start))'


def _touch(a: str, b: str) -> str:
    return f'{a}.contig = {b}.contig AND {a}.start < {b}."end" AND {b}.start < {a}."end"'


def _same(a: str, b: str) -> str:
    return f"{a}.strand = {b}.strand AND {_touch(a, b)}"


def _seeds(t1: float) -> list[str]:
    return [
        f"edges AS (SELECT a.nid AS a, b.nid AS b FROM di a JOIN di b ON {_same('a', 'b')} AND a.nid <> b.nid WHERE {_score1('a', 'b')} >= {t1})",
        "reach(a, b) AS (SELECT nid, nid FROM di UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)",
        "seed AS (SELECT a AS nid, min(b) AS seed FROM reach GROUP BY a)",
        'rep AS (SELECT seed, first(nid ORDER BY ("end" - start) DESC, id, start, "end") AS nid FROM seed JOIN di USING (nid) GROUP BY seed)',
        "reps AS (SELECT di.*, rep.seed FROM rep JOIN di USING (nid))",
    ]


def _parents(t2: float, max5: int | None, tol: int = 12) -> str:
    five = "" if max5 is None else f"""OR greatest(0, CASE WHEN c.strand = '-' THEN d."end" - c."end" ELSE c.start - d.start END) <= {max5}"""
    return f"""parents AS (SELECT * FROM (
        SELECT c.nid, d.nid AS parent, d.start AS parent_start, d."end" AS parent_end, d.id AS parent_id, {_score1('c', 'd')} AS score1, {_score2('c', 'd')} AS score2,
               row_number() OVER (PARTITION BY c.nid ORDER BY {_score2('c', 'd')} DESC, {_score1('c', 'd')} DESC, d.id, d.start, d."end") AS n
        FROM reps c JOIN reps d ON {_same('c', 'd')}
        WHERE d.start < c.start AND d."end" - d.start > c."end" - c.start
          AND CASE WHEN c.strand = '-' THEN d.start <= c.start + {tol} ELSE d."end" + {tol} >= c."end" END
          AND ({_score2('c', 'd')} >= {t2} {five})) WHERE n = 1)"""


def _cluster(t1: float = 0.95, t2: float = 0.80, max5: int | None = None, attach: bool = True, minimum: int = 0) -> str:
    """CTEs up to ``tus`` and ``members``."""
    parts = [READS, DI, *_seeds(t1)]
    if attach:
        parts += [
            _parents(t2, max5),
            "chain(nid, top) AS (SELECT nid, nid FROM reps UNION SELECT c.nid, p.parent FROM chain c JOIN parents p ON c.top = p.nid)",
            "root AS (SELECT c.nid, c.top AS root FROM chain c WHERE c.top NOT IN (SELECT nid FROM parents))",
        ]
    else:
        parts += ["root AS (SELECT nid, nid AS root FROM reps)"]
    parts += [
        "unit_of AS (SELECT seed.nid, root.root FROM seed JOIN rep USING (seed) JOIN root ON root.nid = rep.nid)",
        "unit_n AS (SELECT root, sum(n_reads)::BIGINT AS n_reads FROM unit_of JOIN di USING (nid) GROUP BY root)",
        f"""tus AS (SELECT 'TU' || lpad(CAST(row_number() OVER (ORDER BY {P}, id) AS VARCHAR), 6, '0') AS tu_id, {P}, id, u.n_reads, root FROM unit_n u JOIN di ON di.nid = u.root WHERE u.n_reads >= {minimum})""",
        f"""members AS (SELECT r.id, r.contig, r.strand, r.start, r."end", r.sample, t.tu_id, {_score1('r', 't')} AS score1, {_score2('r', 't')} AS score2
            FROM reads r JOIN di ON r.contig = di.contig AND r.strand = di.strand AND r.start = di.start AND r."end" = di."end" JOIN unit_of USING (nid) JOIN tus t ON t.root = unit_of.root)""",
    ]
    return _with(*parts, recursive=True)


CLUSTER = _cluster()
TU_ROWS = f"SELECT tu_id, {P}, id, n_reads FROM tus"
HITS = f"hits AS (SELECT t.tu_id, g.gene_idx, g.gene_id, t.contig, t.strand, t.start AS tu_start, t.\"end\" AS tu_end, g.start AS gene_start, g.\"end\" AS gene_end, {_bp('t', 'g')} AS overlap_bp FROM tus t JOIN genes g ON {_same('t', 'g')})"
LONG = "long AS (SELECT tu_id, sample, count(*) AS count FROM members GROUP BY ALL)"
PLACES = f"pl AS (SELECT DISTINCT {P} FROM reads)"
ISLANDS = f"""isl AS (SELECT *, sum(CASE WHEN top IS NULL OR start >= top THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY start, "end" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
    FROM (SELECT *, max("end") OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {{0}}))"""
MERGED = f"""merged AS (SELECT contig, strand, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM isl GROUP BY contig, strand, island)"""


def _wide(names: list[str], key: str = "sample", value: str = "count") -> str:
    return ", ".join(f"CAST(coalesce(sum({value}) FILTER (WHERE {key} = '{n}'), 0) AS BIGINT) AS {n}" for n in names)


S4 = ["s0", "s1", "s2", "s3"]
FAM = """fam AS (SELECT *, sum(CASE WHEN prev IS NULL OR p3 - prev > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY p3, p5, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS family FROM (
    SELECT *, lag(p3) OVER (PARTITION BY contig, strand ORDER BY p3, p5, id) AS prev FROM (
        SELECT *, CASE WHEN strand = '-' THEN start ELSE "end" END AS p3, CASE WHEN strand = '-' THEN "end" ELSE start END AS p5 FROM reads)))"""
FMODE = """fmode AS (SELECT contig, strand, family, sum(n)::BIGINT AS family_support, first(p3 ORDER BY n DESC, CASE WHEN strand = '-' THEN -p3 ELSE p3 END DESC) AS c3
    FROM (SELECT contig, strand, family, p3, count(*) AS n FROM fam GROUP BY ALL) GROUP BY contig, strand, family HAVING sum(n) >= 8)"""


def _peak(k: int) -> str:
    """Round k of greedy picking: the best coordinate of what earlier rounds left."""
    taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM peak{j} q WHERE q.contig = h.contig AND q.strand = h.strand AND q.family = h.family AND abs(q.c5 - h.p5) <= 10)" for j in range(1, k))
    return f"""left{k} AS (SELECT * FROM bars h WHERE TRUE{taken}),
    peak{k} AS (SELECT contig, strand, family, first(p5 ORDER BY support DESC, n DESC, pri DESC) AS c5, max(support) AS support FROM (
        SELECT a.contig, a.strand, a.family, a.p5, a.n, CASE WHEN a.strand = '-' THEN a.p5 ELSE -a.p5 END AS pri, sum(b.n) AS support
        FROM left{k} a JOIN left{k} b ON a.contig = b.contig AND a.strand = b.strand AND a.family = b.family AND abs(a.p5 - b.p5) <= 10 GROUP BY a.contig, a.strand, a.family, a.p5, a.n) GROUP BY contig, strand, family)"""


ROUNDS = 14
PEAKS = (
    "bars AS (SELECT contig, strand, family, p5, count(*) AS n FROM fam JOIN fmode USING (contig, strand, family) GROUP BY ALL),\n"
    + ",\n".join(_peak(k) for k in range(1, ROUNDS + 1))
    + ",\npicked AS ("
    + " UNION ALL ".join(f"SELECT *, {k} AS round FROM peak{k}" for k in range(1, ROUNDS + 1))
    + """),
    modes AS (SELECT contig, strand, family, family_support, c3, c5 FROM (SELECT *, row_number() OVER (PARTITION BY contig, strand, family ORDER BY support DESC, CASE WHEN strand = '-' THEN c5 ELSE -c5 END DESC) AS rank FROM picked) JOIN fmode USING (contig, strand, family) WHERE rank <= 3)"""
)
CANDS = """cands AS (SELECT * FROM (SELECT m.contig, m.strand, m.family, m.family_support, m.c3, m.c5, count(*) AS mode_support, count(*) / CAST(m.family_support AS DOUBLE) AS mode_fraction,
        CASE WHEN m.strand = '-' THEN m.c3 ELSE m.c5 END AS start, CASE WHEN m.strand = '-' THEN m.c5 ELSE m.c3 END AS "end"
    FROM modes m JOIN fam f USING (contig, strand, family) WHERE abs(f.p3 - m.c3) <= 12 AND abs(f.p5 - m.c5) <= 10 GROUP BY m.contig, m.strand, m.family, m.family_support, m.c3, m.c5)
    WHERE mode_support >= 5 AND mode_fraction >= 0.02 AND start <= "end")"""
MODES = _with(READS, FAM, FMODE, PEAKS, CANDS)
FEW = _cluster(0.85, 0.5).rstrip()
NEAR = f"""near AS (SELECT * FROM (
    SELECT c.*, t.tu_id AS nearest_tu_id, t.start AS nearest_start, t."end" AS nearest_end, abs(t3 - c3) AS d3, abs(t5 - c5) AS d5, {_score1('c', 't')} AS score1, {_score2('c', 't')} AS score2,
           coalesce(max(CASE WHEN abs(t3 - c3) <= 12 THEN 1 ELSE 0 END) OVER w, 0) AS any3, coalesce(max(CASE WHEN abs(t5 - c5) <= 10 THEN 1 ELSE 0 END) OVER w, 0) AS any5,
           coalesce(max(CASE WHEN abs(t3 - c3) <= 12 AND abs(t5 - c5) <= 10 THEN 1 ELSE 0 END) OVER w, 0) AS same,
           row_number() OVER (PARTITION BY c.contig, c.strand, c.family, c.c5 ORDER BY abs(t3 - c3), abs(t5 - c5), {_score2('c', 't')} DESC, t.tu_id) AS n
    FROM cands c LEFT JOIN (SELECT *, CASE WHEN strand = '-' THEN start ELSE "end" END AS t3, CASE WHEN strand = '-' THEN "end" ELSE start END AS t5 FROM tus) t ON c.contig = t.contig AND c.strand = t.strand
    WINDOW w AS (PARTITION BY c.contig, c.strand, c.family, c.c5)) WHERE n = 1 AND same = 0),
    reasoned AS (SELECT contig, strand, family, c3, c5, family_support, mode_support, mode_fraction, start, "end", nearest_tu_id, nearest_start, nearest_end, d3, d5, score1, score2,
        CASE WHEN any3 = 1 AND any5 = 0 THEN 'same_3p_missing_5p_mode' WHEN any5 = 1 AND any3 = 0 THEN 'same_5p_missing_3p_mode' WHEN any3 = 1 AND any5 = 1 THEN 'boundary_mode_shifted' ELSE 'no_matching_tu' END AS reason FROM near)"""


def _hints(source: str) -> str:
    return f"""hinted AS (SELECT c.*, coalesce(
        (SELECT string_agg(g.gene_id, ',' ORDER BY g.gene_idx) FROM genes g WHERE {_same('g', 'c')}),
        (SELECT first(g.gene_id ORDER BY greatest(0, g.start - c."end", c.start - g."end"), g.gene_idx) FROM genes g WHERE g.contig = c.contig AND g.strand = c.strand), '.') AS gene_hint FROM {source} c)"""


MISSED = f"{FEW},\n{GENES},\n{FAM},\n{FMODE},\n{PEAKS},\n{CANDS},\n{NEAR},\n{_hints('reasoned')}\n"

ORACLES: dict[str, str] = {
    "interval_scalars": _with(READS, 'w AS (SELECT *, start // 1500 * 1500 + 100 AS ws, start // 1500 * 1500 + 900 AS we FROM reads)', 'o AS (SELECT *, greatest(0, least("end", we) - greatest(start, ws)) AS overlap, "end" - start AS len FROM w)')
    + """SELECT id, contig, strand, start, "end", len, overlap, start < we AND ws < "end" AND start < "end" AND ws < we AS hit, CASE WHEN overlap > 0 THEN greatest(start, ws) END AS cut_start, CASE WHEN overlap > 0 THEN least("end", we) END AS cut_end,
        CAST(overlap AS DOUBLE) / (len + 800 - overlap) AS score1, CAST(overlap AS DOUBLE) / greatest(len, 800) AS score2, greatest(0, we + 200 - "end", start - (we + 250)) AS gap,
        CASE WHEN strand = '-' THEN start ELSE "end" END AS p3, CASE WHEN strand = '-' THEN "end" ELSE start END AS p5, greatest(0, CASE WHEN strand = '-' THEN we - "end" ELSE start - ws END) AS delta5,
        CASE WHEN strand = '-' THEN ws <= start + 12 ELSE we + 12 >= "end" END AS within3 FROM o""",
    "read_filter": _with(READS) + f'SELECT {P}, id FROM reads WHERE "end" - start >= 1000',
    "bed6_scan": _with(READS) + f"SELECT {P}, id, CAST(CASE WHEN length(id) % 3 = 0 THEN 0 ELSE length(id) END AS BIGINT) AS score, CAST(CASE WHEN length(id) % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_extra FROM reads",
    "bed12_scan": _with(READS) + 'SELECT id, start AS tx_start, "end" AS tx_end, 200 + 300 AS exon_bp_, 1 FROM reads LIMIT 0',
    "tsv_scan": _with(READS) + f"SELECT {P}, id FROM reads",
    "gff_scan": _with(GENES, "kept AS (SELECT *, row_number() OVER (ORDER BY gene_idx) AS n FROM genes WHERE gene_idx % 5 <> 0)")
    + f"SELECT n AS gene_idx, {P}, CASE gene_idx % 4 WHEN 0 THEN gene_id WHEN 1 THEN gene_id WHEN 2 THEN gene_id || '=2' ELSE 'gene_' || n END AS gene_id FROM kept",
    "pooled_union": _with(READS) + f"SELECT sample || '::' || id AS id, sample, {P} FROM reads",
    "overlap_join": _with(READS, GENES, PLACES) + f"SELECT a.contig, a.strand, a.start, a.\"end\", b.gene_idx, b.start AS b_start, b.\"end\" AS b_end, {_bp('a', 'b')} AS overlap_bp FROM pl a JOIN genes b ON {_same('a', 'b')}",
    "overlap_join_min_bp": _with(READS, GENES, PLACES) + f"SELECT a.contig, a.strand, a.start, a.\"end\", b.gene_idx, b.start AS b_start, b.\"end\" AS b_end, {_bp('a', 'b')} AS overlap_bp FROM pl a JOIN genes b ON {_same('a', 'b')} WHERE {_bp('a', 'b')} >= 250",
    "overlap_join_any_strand": _with(READS, GENES, PLACES) + f"SELECT a.contig, a.strand, b.strand AS b_strand, b.gene_idx, count(*) AS n, sum({_bp('a', 'b')})::BIGINT AS overlap_bp FROM pl a JOIN genes b ON {_touch('a', 'b')} GROUP BY ALL",
    "regions_islands": _with(READS, ISLANDS.format("reads")) + 'SELECT contig, strand, island::BIGINT AS island, min(start) AS start, max("end") AS "end", count(*) AS n FROM isl GROUP BY contig, strand, island',
    "cluster_stats": _with(READS, ISLANDS.format("reads"), "a AS (SELECT contig, strand, count(*) AS n, max(island) AS regions FROM isl GROUP BY ALL)", "b AS (SELECT count(*) AS n FROM isl GROUP BY contig, strand, island)")
    + "SELECT count(*) AS partitions, sum(regions)::BIGINT AS regions, max(n) AS max_partition_reads, max(regions)::BIGINT AS max_partition_regions, (SELECT max(n) FROM b) AS max_region_reads FROM a",
    "span_clusters": _with(READS, """t AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end", strand, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM reads)""", """u AS (SELECT *, sum(CASE WHEN top IS NULL OR start >= top THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end", strand, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t)""")
    + 'SELECT contig, min(start) AS start, max("end") AS "end", count(*) AS members FROM u GROUP BY contig, k',
    "span_clusters_match": _with(
        READS, """l AS (SELECT *, lag(strand) OVER (PARTITION BY contig ORDER BY start, "end", strand, id) AS before FROM reads)""",
        """r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> strand THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end", strand, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)""",
        """t AS (SELECT *, max("end") OVER (PARTITION BY contig, run ORDER BY start, "end", strand, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)""",
        """u AS (SELECT *, sum(CASE WHEN top IS NULL OR start >= top THEN 1 ELSE 0 END) OVER (PARTITION BY contig, run ORDER BY start, "end", strand, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t)""",
    ) + 'SELECT contig, any_value(strand) AS strand, min(start) AS start, max("end") AS "end", count(*) AS members FROM u GROUP BY contig, run, k',
    "merge_overlaps": _with(GENES, ISLANDS.format("genes"), MERGED) + f"SELECT {P}, n_merged FROM merged",
    "list_lengths": _with(
        GENES, ISLANDS.format("genes"), MERGED, "m AS (SELECT *, start // 30000 AS block FROM merged)", "k AS (SELECT DISTINCT contig, block FROM m)",
        """l AS (SELECT contig, block, coalesce(sum("end" - start) FILTER (WHERE strand = '+'), 0)::BIGINT AS len_a, coalesce(sum("end" - start) FILTER (WHERE strand = '-'), 0)::BIGINT AS len_b FROM m GROUP BY ALL)""",
        f"""i AS (SELECT a.contig, a.block, sum({_bp('a', 'b')})::BIGINT AS shared_bp FROM m a JOIN m b ON a.contig = b.contig AND a.block = b.block AND a.strand = '+' AND b.strand = '-' GROUP BY ALL)""",
        "j AS (SELECT l.*, coalesce(shared_bp, 0) AS shared_bp FROM l LEFT JOIN i USING (contig, block))",
    ) + 'SELECT contig, block, len_a, len_b, shared_bp, len_a + len_b - shared_bp AS covered_bp, CASE WHEN len_a + len_b - shared_bp = 0 THEN 0.0::DOUBLE ELSE shared_bp / (len_a + len_b - shared_bp)::DOUBLE END AS score1, CASE WHEN greatest(len_a, len_b) = 0 THEN 0.0::DOUBLE ELSE shared_bp / greatest(len_a, len_b)::DOUBLE END AS score2, shared_bp AS walked FROM j',
    "seed_edges": _with(READS, PLACES) + f"SELECT a.contig, a.strand, a.start AS a_start, a.\"end\" AS a_end, b.start AS b_start, b.\"end\" AS b_end, {_score1('a', 'b')} AS score1 FROM pl a JOIN pl b ON {_same('a', 'b')} AND (a.start < b.start OR a.start = b.start AND a.\"end\" < b.\"end\") WHERE {_score1('a', 'b')} >= 0.95",
    "seed_edges_low": _with(READS, PLACES) + f"SELECT a.contig, a.strand, a.start AS a_start, count(*) AS n, min({_score1('a', 'b')}) AS least FROM pl a JOIN pl b ON {_same('a', 'b')} AND (a.start < b.start OR a.start = b.start AND a.\"end\" < b.\"end\") WHERE {_score1('a', 'b')} >= 0.3 GROUP BY ALL",
    "seed_components": _with(READS, DI, *_seeds(0.95), recursive=True) + 'SELECT d.contig, d.strand, d.start, d."end", g.n, g.n_reads, g.last_end FROM (SELECT min(nid) AS nid, count(*) AS n, sum(n_reads)::BIGINT AS n_reads, max("end") AS last_end FROM seed JOIN di USING (nid) GROUP BY seed) g JOIN di d USING (nid)',
    "representatives": _with(READS, DI, *_seeds(0.95), recursive=True) + f"SELECT {P}, id FROM reps",
    "attach_parents": _with(READS, DI, *_seeds(0.95), _parents(0.80, None), recursive=True) + 'SELECT d.contig, d.strand, d.start, d."end", d.id, parent_start, parent_end, parent_id, score1, score2 FROM parents JOIN di d USING (nid)',
    "attach_five_prime_override": _with(READS, DI, *_seeds(0.95), _parents(0.9, 40), recursive=True) + 'SELECT d.contig, d.strand, d.start, d."end", d.id, parent_start, parent_end, parent_id, score1, score2 FROM parents JOIN di d USING (nid)',
    "cluster_tus": CLUSTER + TU_ROWS,
    "cluster_tus_seed_only": _cluster(attach=False) + TU_ROWS,
    "cluster_tus_by_joins": CLUSTER + TU_ROWS,
    "cluster_tus_override": _cluster(t2=0.9, max5=40) + TU_ROWS,
    "membership_scores": CLUSTER + f"SELECT id, {P}, tu_id, score1, score2 FROM members",
    "min_tu_count_filter": _cluster(minimum=20) + TU_ROWS,
    "tu_counts": CLUSTER + "SELECT tu_id, count(*) AS count FROM members GROUP BY tu_id",
    "tu_sample_long": CLUSTER + "SELECT tu_id, sample, count(*) AS count FROM members GROUP BY ALL",
    "tu_sample_matrix": CLUSTER.rstrip() + f",\n{LONG}\nSELECT tu_id, {_wide(S4)} FROM long GROUP BY tu_id",
    "tu_group_matrix": CLUSTER.rstrip() + f",\n{LONG},\n{SAMPLES}\nSELECT tu_id, {_wide(['even', 'odd'], 'grp')} FROM long JOIN samples USING (sample) GROUP BY tu_id",
    "recount": CLUSTER.rstrip() + f",\n{LONG}\nSELECT tu_id, sample, count FROM long WHERE tu_id IN (SELECT tu_id FROM long GROUP BY tu_id HAVING sum(count) >= 20)",
    "fractional_counts": """WITH li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), x AS (SELECT * FROM li WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 0)), s AS (SELECT l_partkey, 1.0::DOUBLE / count(*) AS share FROM x GROUP BY ALL),
        c AS (SELECT l_orderkey, sum(share) AS count FROM x JOIN s USING (l_partkey) GROUP BY ALL) SELECT CAST(k.l_orderkey AS VARCHAR) AS isoform_id, round(coalesce(c.count, 0), 9) AS count FROM (SELECT DISTINCT l_orderkey FROM li) k LEFT JOIN c USING (l_orderkey)""",
    "tu_gene_overlap": CLUSTER.rstrip() + f",\n{GENES},\n{HITS}\nSELECT contig, strand, tu_id, tu_start, tu_end, gene_id, gene_start, gene_end, overlap_bp FROM hits",
    "gene_counts": CLUSTER.rstrip() + f",\n{GENES},\n{HITS},\nk AS (SELECT gene_idx, sum(n_reads)::BIGINT AS count FROM hits JOIN tus USING (tu_id) GROUP BY gene_idx)\nSELECT gene_idx, gene_id, coalesce(count, 0) AS count FROM genes LEFT JOIN k USING (gene_idx)",
    "gene_sample_matrix": CLUSTER.rstrip() + f",\n{GENES},\n{HITS},\n{LONG},\nk AS (SELECT gene_idx, sample, sum(count) AS count FROM hits JOIN long USING (tu_id) GROUP BY ALL)\nSELECT g.gene_idx, g.gene_id, {_wide(S4)} FROM genes g LEFT JOIN k USING (gene_idx) GROUP BY ALL",
    "bed12_blocks": CLUSTER.rstrip() + f""",\n{GENES},\n{HITS},
        h AS (SELECT tu_id, count(*) AS n, string_agg(CAST(least(tu_end, gene_end) - greatest(tu_start, gene_start) AS VARCHAR), ',' ORDER BY gene_start, gene_end, gene_id) || ',' AS sizes, string_agg(CAST(greatest(tu_start, gene_start) - tu_start AS VARCHAR), ',' ORDER BY gene_start, gene_end, gene_id) || ',' AS starts, string_agg(gene_id, ',' ORDER BY gene_start, gene_end, gene_id) AS ids FROM hits GROUP BY tu_id),
        m AS (SELECT tu_id, string_agg(id, ',' ORDER BY start, "end", id) || ',|' || count(*) AS name2 FROM members GROUP BY tu_id)
        SELECT t.tu_id, t.contig, t.strand, t.start, t."end", coalesce(h.n, 1) AS block_count, coalesce(h.sizes, (t."end" - t.start) || ',') AS block_sizes, coalesce(h.starts, '0,') AS block_starts, m.name2, coalesce(h.ids, '.') AS gene_list FROM tus t LEFT JOIN h USING (tu_id) LEFT JOIN m USING (tu_id)""",
    "junction_subset": _with(
        GENES, "e AS (SELECT DISTINCT contig, strand, start // 6000 AS locus, start // 100 * 100 AS s FROM genes)", "c AS (SELECT contig, strand, locus, list(s ORDER BY s) AS x FROM e GROUP BY ALL)",
        "i AS (SELECT contig, strand, locus, list_filter(list_transform(range(1, len(x)), lambda k: (x[k] + 50) || '-' || x[k + 1]), lambda k: split_part(k, '-', 1)::BIGINT < split_part(k, '-', 2)::BIGINT) AS g FROM c)",
    ) + "SELECT a.contig, a.locus, a.strand, b.strand AS other, len(a.g)::BIGINT AS n_introns, len(list_filter(a.g, lambda k: NOT list_contains(b.g, k))) = 0 AS part, a.g = b.g AS same FROM i a JOIN i b ON a.contig = b.contig AND a.locus = b.locus AND a.strand <> b.strand",
    "three_prime_families": _with(READS, FAM) + "SELECT contig, strand, family, count(*) AS n, min(p3) AS first3, max(p3) AS last3 FROM fam GROUP BY contig, strand, family",
    "family_mode_coord": _with(READS, FAM, FMODE) + "SELECT contig, strand, family, family_support, c3 FROM fmode",
    "five_prime_modes": _with(READS, FAM, FMODE, PEAKS) + "SELECT contig, strand, family, family_support, c3, c5 FROM modes",
    "candidate_modes": MODES + f"SELECT {P}, family, family_support, c3, c5, mode_support, mode_fraction FROM cands",
    "nearest_tu": MISSED + "SELECT * FROM reasoned",
    "gene_hint": MODES.rstrip() + f",\n{GENES},\n{_hints('cands')}\nSELECT {P}, gene_hint FROM hinted",
    "diagnose_missed": MISSED + f"SELECT *, 'MISS' || lpad(CAST(row_number() OVER (ORDER BY {P}, mode_support DESC) AS VARCHAR), CAST(greatest(4, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS candidate_id FROM hinted",
}

# Rescue: the spec's steps one after another, with one read for each id.
RESCUE = f"""{MISSED.rstrip()},
    {{greedy}},
    rfam AS (SELECT id, contig, strand, family FROM fam),
    one AS (SELECT id, max(struct_pack(contig := contig, strand := strand, s := start, e := "end")) AS p FROM reads GROUP BY id),
    rd AS (SELECT id, p.contig AS contig, p.strand AS strand, p.s AS start, p.e AS "end", CASE WHEN p.strand = '-' THEN p.s ELSE p.e END AS p3, CASE WHEN p.strand = '-' THEN p.e ELSE p.s END AS p5 FROM one),
    own AS (SELECT id, last(tu_id ORDER BY contig, strand, start, "end") AS tu_id FROM members GROUP BY id),
    fits AS (SELECT r.id, h.contig, h.strand, h.c3, h.c5, h.start AS cs, h."end" AS ce, abs(r.p3 - h.c3) AS d3, abs(r.p5 - h.c5) AS d5, h.mode_support, h.cand_idx
        FROM kept h JOIN rfam f USING (contig, strand, family) JOIN rd r ON r.id = f.id WHERE abs(r.p3 - h.c3) <= 12 AND abs(r.p5 - h.c5) <= 10),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d3, d5, mode_support DESC, cand_idx) AS n FROM fits) WHERE n = 1),
    gate1 AS (SELECT cand_idx FROM best GROUP BY cand_idx HAVING count(*) >= 5),
    now AS (SELECT o.id, o.tu_id, t.start AS us, t."end" AS ue, CASE WHEN t.strand = '-' THEN t.start ELSE t."end" END AS t3, CASE WHEN t.strand = '-' THEN t."end" ELSE t.start END AS t5 FROM own o LEFT JOIN tus t USING (tu_id)),
    used AS (SELECT b.* FROM best b JOIN gate1 USING (cand_idx) JOIN rd r USING (id) LEFT JOIN now n USING (id) WHERE n.t3 IS NULL OR d3 < abs(n.t3 - r.p3) OR (d3 = abs(n.t3 - r.p3) AND d5 <= abs(n.t5 - r.p5))),
    gate2 AS (SELECT cand_idx, row_number() OVER (ORDER BY cand_idx) AS k, count(*) OVER () AS total FROM (SELECT cand_idx FROM used GROUP BY cand_idx HAVING count(*) >= 5)),
    named AS (SELECT k.*, 'RESC' || lpad(CAST(g.k AS VARCHAR), CAST(greatest(4, length(CAST(total AS VARCHAR))) AS INTEGER), '0') AS rescue_id FROM kept k JOIN gate2 g USING (cand_idx)),
    final AS (SELECT r.id, r.contig, r.strand, r.start, r."end", coalesce(m.rescue_id, n.tu_id) AS tu_id, coalesce(m.start, n.us) AS us, coalesce(m."end", n.ue) AS ue FROM rd r LEFT JOIN used u USING (id) LEFT JOIN named m ON m.cand_idx = u.cand_idx LEFT JOIN now n ON n.id = r.id)
"""


def _greedy(source: str, near3: int, near5: int) -> str:
    """Best first, each contig and strand walked by recursion: what lies near a kept one goes."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY contig, strand ORDER BY mode_support DESC, mode_fraction DESC, start, "end") AS o FROM {source}),
    greedy(contig, strand, o, taken) AS (
        SELECT contig, strand, 1::BIGINT, [struct_pack(c3 := c3, c5 := c5, o := o)] FROM ordered WHERE o = 1
        UNION ALL SELECT g.contig, g.strand, g.o + 1, CASE WHEN len(list_filter(g.taken, lambda k: abs(k.c3 - x.c3) <= {near3} AND abs(k.c5 - x.c5) <= {near5})) > 0 THEN g.taken ELSE list_append(g.taken, struct_pack(c3 := x.c3, c5 := x.c5, o := x.o)) END
        FROM greedy g JOIN ordered x ON x.contig = g.contig AND x.strand = g.strand AND x.o = g.o + 1),
    ends AS (SELECT contig, strand, last(taken ORDER BY o) AS taken FROM greedy GROUP BY ALL),
    kept AS (SELECT o.*, row_number() OVER (ORDER BY o.contig, o.strand, o.start, o."end", mode_support DESC) AS cand_idx FROM ordered o JOIN ends e ON e.contig = o.contig AND e.strand = o.strand AND len(list_filter(e.taken, lambda k: k.o = o.o)) > 0)"""


def _rescued(select: str) -> str:
    return RESCUE.replace("{greedy}", _greedy("hinted", 12, 10)) + select


ORACLES["rescue_membership"] = _rescued(f"SELECT id, {P}, tu_id, {_score1('f', 'u')} AS score1, {_score2('f', 'u')} AS score2 FROM (SELECT id, {P}, tu_id, us, ue FROM final WHERE tu_id IS NOT NULL) f, LATERAL (SELECT f.us AS start, f.ue AS \"end\") u".replace(f"SELECT id, {P}, tu_id, {_score1('f', 'u')}", f"SELECT id, contig, strand, f.start, f.\"end\", tu_id, {_score1('f', 'u')}", 1))
ORACLES["rescue_units"] = _rescued("SELECT f.tu_id, any_value(coalesce(n.contig, t.contig)) AS contig, any_value(coalesce(n.strand, t.strand)) AS strand, any_value(coalesce(n.start, t.start)) AS start, any_value(coalesce(n.\"end\", t.\"end\")) AS \"end\", count(*) AS n_reads FROM final f LEFT JOIN tus t USING (tu_id) LEFT JOIN named n ON n.rescue_id = f.tu_id WHERE f.tu_id IS NOT NULL GROUP BY f.tu_id")
ORACLES["bed12_scan"] = _with(READS, 'x AS (SELECT *, "end" - 300 AS s2 FROM reads)') + """SELECT id, start AS tx_start, "end" AS tx_end, 500::BIGINT AS exon_bp, CASE WHEN start + 200 < s2 THEN 1 ELSE 0 END::BIGINT AS n_introns, CASE WHEN start + 200 < s2 THEN start + 200 END AS intron_start, CASE WHEN start + 200 < s2 THEN s2 END AS intron_end FROM x"""
ORACLES["dedup_candidates"] = _with(READS, FAM, FMODE, PEAKS, CANDS, _greedy("cands", 400, 400), recursive=True) + f"SELECT {P}, family, family_support, c3, c5, mode_support, mode_fraction, cand_idx FROM kept"
ORACLES["representative_transcripts"] = _with(READS) + 'SELECT contig AS chrom, strand, start AS tx_start, "end" AS tx_end, id AS name, locus FROM (SELECT *, start // 1500 AS locus, row_number() OVER (PARTITION BY contig, strand, start // 1500 ORDER BY "end" - start DESC, id) AS n FROM reads) WHERE n = 1'
ORACLES["intersect_transcripts"] = _with(READS, GENES) + f"SELECT g.gene_id AS b_name, count(*) AS n, sum({_bp('r', 'g')})::BIGINT AS overlap_bp FROM reads r JOIN genes g ON {_touch('r', 'g')} WHERE {_bp('r', 'g')} >= 300 GROUP BY g.gene_id"

ORACLES["interval_flags"] = _with(READS, "x AS (SELECT *, greatest(start, start // 1500 * 1500 + 1000) AS stop FROM reads)") + "SELECT id, start, stop, stop <= start AS empty, strand AS matched, CAST(NULL AS VARCHAR) AS any_strand FROM x"
ORACLES["gene_kinds"] = _with(GENES) + "SELECT gene_idx, CASE gene_idx % 3 WHEN 0 THEN 'mRNA' WHEN 1 THEN 'ncRNA_' || gene_idx ELSE 'gene' END AS kind FROM genes"
ORACLES["bed6_reads"] = ORACLES["bed12_reads"] = _with(READS) + f"SELECT {P}, id FROM reads"
ORACLES["bam_scan"] = _with(READS) + "SELECT contig, start, \"end\", id, CAST(length(id) % 60 AS BIGINT) AS score, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand FROM reads WHERE \"end\" - start > 100"
ORACLES["bed6_lines"] = CLUSTER + "SELECT tu_id, contig || chr(9) || start || chr(9) || \"end\" || chr(9) || tu_id || chr(9) || '0' || chr(9) || strand AS line FROM tus"
ORACLES["bed12_lines"] = _with(GENES, ISLANDS.format("genes"), MERGED) + """SELECT concat_ws(chr(9), contig, start, "end", 'm', n_merged, strand, start, "end", '0', 1, ("end" - start) || ',', '0,') AS line FROM merged"""
ORACLES["membership_scan"] = CLUSTER + "SELECT sample || '::' || id AS id, tu_id FROM members"
ORACLES["tu_counts_least"] = CLUSTER + "SELECT tu_id, count(*) AS count FROM members GROUP BY tu_id HAVING count(*) >= 20"
ORACLES["unknown_samples"] = _with(READS) + "SELECT DISTINCT sample FROM reads WHERE sample IN ('s1', 's3')"
ORACLES["unit_ids"] = CLUSTER + "SELECT sample, string_agg(DISTINCT tu_id, ',' ORDER BY tu_id) AS tu_ids FROM members GROUP BY sample"
ORACLES["gene_group_matrix"] = CLUSTER.rstrip() + f",\n{GENES},\n{HITS},\n{LONG},\n{SAMPLES},\nk AS (SELECT gene_idx, grp, sum(count) AS count FROM hits JOIN long USING (tu_id) JOIN samples USING (sample) GROUP BY ALL)\nSELECT g.gene_idx, g.gene_id, {_wide(['even', 'odd'], 'grp')} FROM genes g LEFT JOIN k USING (gene_idx) GROUP BY ALL"
ORACLES["transcript_order"] = _with(READS) + 'SELECT contig AS chrom, strand, start AS tx_start, "end" AS tx_end, id AS name, row_number() OVER (ORDER BY contig, start, "end", strand, id) AS place FROM reads'
ORACLES["pooled_lines"] = _with(READS) + """SELECT concat_ws(chr(9), contig, start, "end", sample || '::' || id, 0, strand) AS value FROM reads"""
ORACLES["gene_lines"] = _with(GENES) + """SELECT concat_ws(chr(9), contig, start, "end", gene_id, 0, strand) AS value FROM genes"""
ORACLES["membership_lines"] = CLUSTER + "SELECT concat_ws(chr(9), id, tu_id, printf('%.6f', score1), printf('%.6f', score2)) AS value FROM members"
ORACLES["tu_count_lines"] = CLUSTER + "SELECT tu_id || ',' || n_reads AS value FROM tus"
ORACLES["sample_count_lines"] = CLUSTER + "SELECT tu_id || chr(9) || sample || chr(9) || count(*) AS value FROM members GROUP BY tu_id, sample"
ORACLES["tu_gene_lines"] = CLUSTER.rstrip() + f",\n{GENES},\n{HITS}\nSELECT concat_ws(chr(9), contig, strand, tu_id, tu_start, tu_end, gene_id, gene_start, gene_end, overlap_bp) AS value FROM hits"
ORACLES["read_unit_lines"] = _cluster(attach=False) + "SELECT id || chr(9) || tu_id AS value FROM members"
