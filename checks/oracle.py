"""Independent DuckDB statements of every query, written from the definitions.

The SQL states what a result is (whole-window equality, a two-edge path with the same
label, reachability); it follows none of the join strategies or loops of the Spark side.
"""

from __future__ import annotations

import re

L = 40
LN2 = "0.6931471805599453"

ATTRS = ("mapped_read_count", "num_inner_vertices", "a_statistic", "traversal_count", "is_special")
FRESH = """1.0::DOUBLE AS mapped_read_count, 0 AS num_inner_vertices, 0.0::DOUBLE AS a_statistic,
           0 AS traversal_count, false AS is_special"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def digest(tag: str) -> str:
    return f"('0x' || substr(md5('{tag}' || event_id::VARCHAR), 1, 7))::BIGINT"


CTES: dict[str, str] = {}

CTES["block"] = """
    SELECT p_partkey AS block_no, translate(md5(CASE
        WHEN p_partkey % 1000 BETWEEN 100 AND 104 OR p_partkey % 1000 BETWEEN 150 AND 154
        THEN 'r' || (p_partkey // 1000)::VARCHAR || '_' || (p_partkey % 50)::VARCHAR
        ELSE 'g' || p_partkey::VARCHAR END), '0123456789abcdef', 'ACGTACGTACGTACGT') AS bases
    FROM part"""
CTES["genome"] = "SELECT string_agg(bases, '' ORDER BY block_no) AS s FROM block"
CTES["layout"] = f"""
    SELECT event_id AS read_id, 80 + {digest('l')} % 41 AS n, {digest('p')} AS place,
           {digest('s')} % 2 = 1 AS flipped FROM events"""
CTES["cut"] = """
    SELECT read_id, flipped, substr(s, (place % (length(s) - n + 1) + 1)::BIGINT, n::BIGINT) AS w
    FROM layout, genome"""
CTES["reads"] = f"SELECT read_id, CASE WHEN flipped THEN {rc('w')} ELSE w END AS seq FROM cut"

CTES["word"] = f"""
    SELECT read_id, pos, substr(seq, pos + 1, {L}) AS w FROM (
        SELECT read_id, seq, unnest(range(0, length(seq) - {L} + 1)) AS pos FROM reads)"""
CTES["occurrence"] = f"""
    SELECT least(w, {rc('w')}) AS kmer, read_id, pos::INTEGER AS pos, NOT (w < {rc('w')}) AS rc FROM word"""

CTES["oriented"] = f"SELECT read_id, false AS o, seq FROM reads UNION ALL SELECT read_id, true, {rc('seq')} FROM reads"
CTES["win"] = f"""
    SELECT read_id AS a, o AS ao, seq AS s, p, substr(seq, p + 1, {L}) AS key FROM (
        SELECT *, unnest(range(0, length(seq) - {L} + 1)) AS p FROM oriented WHERE length(seq) >= {L})"""
CTES["pre"] = f"SELECT read_id AS b, o AS bo, seq AS t, substr(seq, 1, {L}) AS key FROM oriented WHERE length(seq) >= {L}"
CTES["cand"] = """
    SELECT a, ao, length(s) AS la, p, b, bo, length(t) AS lb, least(length(s) - p, length(t)) AS n
    FROM win JOIN pre USING (key)
    WHERE NOT (ao AND bo)
      AND substr(s, p + 1, least(length(s) - p, length(t))) = substr(t, 1, least(length(s) - p, length(t)))"""
CTES["placed"] = """
    SELECT a, CASE WHEN ao THEN la - p - n ELSE p END AS a_beg, la,
           b, CASE WHEN bo THEN lb - n ELSE 0 END AS b_beg, lb, n, ao <> bo AS rc FROM cand"""
CTES["sided"] = """
    SELECT a AS f, a_beg AS f_beg, la AS f_len, b AS g, b_beg AS g_beg, lb AS g_len, n, rc
    FROM placed WHERE a < b OR (a = b AND a_beg < b_beg)
    UNION ALL
    SELECT b, b_beg, lb, a, a_beg, la, n, rc FROM placed WHERE b < a OR (a = b AND b_beg < a_beg)"""
CTES["overlap"] = """
    SELECT f, f_beg::INTEGER AS f_beg, (f_beg + n - 1)::INTEGER AS f_end,
           g, g_beg::INTEGER AS g_beg, (g_beg + n - 1)::INTEGER AS g_end, rc,
           f_len::INTEGER AS f_len, g_len::INTEGER AS g_len
    FROM sided
    QUALIFY row_number() OVER (PARTITION BY f, g, f_beg > 0, rc ORDER BY n DESC, f_beg, g_beg) = 1"""

CTES["contained"] = """
    SELECT DISTINCT CASE WHEN f_beg = 0 AND f_end = f_len - 1 THEN f ELSE g END AS read_id FROM overlap
    WHERE (f_beg = 0 AND f_end = f_len - 1) OR (g_beg = 0 AND g_end = g_len - 1)"""
CTES["index_map"] = """
    SELECT read_id AS old_id, CASE WHEN read_id NOT IN (SELECT read_id FROM contained)
           THEN count(*) FILTER (WHERE read_id NOT IN (SELECT read_id FROM contained))
                OVER (ORDER BY read_id) - 1 END AS new_id FROM reads"""
CTES["kept"] = "SELECT old_id, new_id FROM index_map WHERE new_id IS NOT NULL"
CTES["kept_read"] = "SELECT new_id AS read_id, seq FROM reads JOIN kept ON old_id = read_id"
CTES["kept_overlap"] = """
    SELECT kf.new_id AS f, f_beg, f_end, kg.new_id AS g, g_beg, g_end, rc, f_len, g_len
    FROM overlap JOIN kept kf ON kf.old_id = f JOIN kept kg ON kg.old_id = g"""

CTES["numbered"] = """
    SELECT o.*, rf.seq AS fs, rg.seq AS gs,
           row_number() OVER (ORDER BY f, g, f_beg > 0, rc) - 1 AS k
    FROM kept_overlap o JOIN kept_read rf ON rf.read_id = f JOIN kept_read rg ON rg.read_id = g
    WHERE NOT (f_beg = 0 AND f_end = f_len - 1) AND NOT (g_beg = 0 AND g_end = g_len - 1)"""
CTES["edge"] = f"""
    SELECT 2 * k AS edge_id, 2 * k + 1 AS twin_id,
           2 * f + CASE WHEN f_beg > 0 THEN 1 ELSE 0 END AS v1,
           2 * g + CASE WHEN f_beg > 0 AND NOT rc OR f_beg = 0 AND rc THEN 1 ELSE 0 END AS v2,
           CASE WHEN f_beg > 0 AND NOT rc THEN substr(gs, g_end + 2)
                WHEN f_beg > 0 AND rc THEN {rc('substr(gs, 1, g_beg)')}
                WHEN f_beg = 0 AND rc THEN substr(gs, g_end + 2)
                ELSE {rc('substr(gs, 1, g_beg)')} END AS seq
    FROM numbered
    UNION ALL
    SELECT 2 * k + 1, 2 * k,
           2 * g + CASE WHEN f_beg > 0 AND NOT rc OR f_beg = 0 AND rc THEN 0 ELSE 1 END,
           2 * f + CASE WHEN f_beg > 0 THEN 0 ELSE 1 END,
           CASE WHEN f_beg > 0 THEN {rc('substr(fs, 1, f_beg)')} ELSE substr(fs, f_end + 2) END
    FROM numbered"""
CTES["transitive"] = """
    SELECT DISTINCT e3.edge_id FROM edge e1 JOIN edge e2 ON e1.v2 = e2.v1
    JOIN edge e3 ON e3.v1 = e1.v1 AND e3.v2 = e2.v2 AND length(e3.seq) = length(e1.seq) + length(e2.seq)
    WHERE e1.seq || e2.seq = e3.seq"""
CTES["reduced"] = "SELECT * FROM edge WHERE edge_id NOT IN (SELECT edge_id FROM transitive)"
CTES["vertex"] = "SELECT 2 * new_id AS v FROM kept UNION ALL SELECT 2 * new_id + 1 FROM kept"

CTES["container"] = """
    SELECT CASE WHEN f_beg = 0 AND f_end = f_len - 1 THEN f ELSE g END AS read_id,
           CASE WHEN f_beg = 0 AND f_end = f_len - 1 THEN g ELSE f END AS old_id,
           CASE WHEN f_beg = 0 AND f_end = f_len - 1 THEN g_beg ELSE f_beg END AS before,
           CASE WHEN f_beg = 0 AND f_end = f_len - 1 THEN g_len - g_end - 1 ELSE f_len - f_end - 1 END AS after,
           f, g, (f_beg > 0)::INTEGER * 2 + rc::INTEGER AS type, rc
    FROM overlap
    WHERE (f_beg = 0 AND f_end = f_len - 1) OR (g_beg = 0 AND g_end = g_len - 1)"""
CTES["over"] = """
    SELECT read_id, CASE WHEN rc THEN before ELSE after END AS overhang, new_id AS over_read, rc AS over_rc
    FROM container JOIN kept USING (old_id)
    QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN rc THEN before ELSE after END, f, g, type) = 1"""
CTES["under"] = """
    SELECT read_id, CASE WHEN rc THEN after ELSE before END AS underhang, new_id AS under_read, rc AS under_rc
    FROM container JOIN kept USING (old_id)
    QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN rc THEN after ELSE before END, f, g, type) = 1"""
CTES["overhang"] = "SELECT * FROM over JOIN under USING (read_id)"
CTES["walk_end"] = """
    SELECT 2 * over_read + CASE WHEN over_rc THEN 0 ELSE 1 END AS v, overhang AS residual FROM overhang
    UNION ALL
    SELECT 2 * under_read + CASE WHEN under_rc THEN 1 ELSE 0 END, underhang FROM overhang"""
CTES["walk_start"] = "SELECT v, residual, count(*) AS reads FROM walk_end GROUP BY v, residual"
CTES["walk"] = """
    SELECT v, residual, v AS at, residual::BIGINT AS remain, -1::BIGINT AS edge_id FROM walk_start
    UNION ALL
    SELECT w.v, w.residual, e.v1, w.remain - length(e.seq), e.edge_id
    FROM walk w JOIN reduced e ON e.v2 = w.at WHERE w.remain >= 0"""
CTES["every_hit"] = "SELECT v, residual, edge_id, count(*) AS hits FROM walk WHERE remain < 0 GROUP BY ALL"
CTES["hit"] = """
    SELECT * FROM every_hit WHERE (v, residual) IN
        (SELECT (v, residual) FROM every_hit GROUP BY v, residual)"""
CTES["added"] = """
    SELECT edge_id, sum(reads * hits / n) AS added
    FROM hit JOIN (SELECT v, residual, sum(hits) AS n FROM hit GROUP BY v, residual) USING (v, residual)
    JOIN walk_start USING (v, residual) GROUP BY edge_id"""
CTES["mapped"] = """
    SELECT r.*, 1.0 + coalesce(added, 0.0) AS mapped_read_count, 0 AS num_inner_vertices,
           0.0::DOUBLE AS a_statistic, 0 AS traversal_count, false AS is_special
    FROM reduced r LEFT JOIN added USING (edge_id)"""

CTES["degree"] = """
    SELECT v, (SELECT count(*) FROM reduced WHERE v2 = v) AS in_degree,
           (SELECT count(*) FROM reduced WHERE v1 = v) AS out_degree FROM vertex"""
CTES["inner_v"] = "SELECT v FROM degree WHERE in_degree = 1 AND out_degree = 1"
CTES["path"] = """
    SELECT edge_id AS head, 0 AS pos, edge_id, twin_id, v2 FROM mapped WHERE v1 NOT IN (SELECT v FROM inner_v)
    UNION ALL
    SELECT p.head, p.pos + 1, e.edge_id, e.twin_id, e.v2
    FROM path p JOIN inner_v i ON i.v = p.v2 JOIN mapped e ON e.v1 = p.v2"""
CTES["path_sum"] = """
    SELECT head AS edge_id, max_by(p.twin_id, pos) AS twin_id, max_by(p.v2, pos) AS v2,
           string_agg(seq, '' ORDER BY pos) AS seq, sum(mapped_read_count) AS mapped_read_count,
           max(pos)::INTEGER AS num_inner_vertices
    FROM path p JOIN mapped m USING (edge_id) GROUP BY head"""
CTES["collapsed"] = """
    SELECT p.edge_id, p.twin_id, m.v1, p.v2, p.seq, p.mapped_read_count, p.num_inner_vertices,
           m.a_statistic, m.traversal_count, m.is_special
    FROM path_sum p JOIN mapped m USING (edge_id)
    UNION ALL
    SELECT edge_id, twin_id, v1, v2, seq, mapped_read_count, num_inner_vertices, a_statistic,
           traversal_count, is_special
    FROM mapped WHERE edge_id NOT IN (SELECT edge_id FROM path)"""
CTES["collapsed_v"] = """
    SELECT v FROM vertex WHERE v NOT IN
        (SELECT v FROM inner_v WHERE v IN (SELECT v2 FROM path))"""

CTES["m"] = "SELECT edge_id, v1, length(seq) AS len, floor(mapped_read_count + 1e-6) AS reads FROM collapsed"
CTES["rate0"] = """
    SELECT CASE WHEN l = 0 THEN 0.0 ELSE n / l END AS rate FROM
        (SELECT coalesce(sum(CASE WHEN v1 % 2 = 1 THEN len END), 0)::DOUBLE AS l FROM m),
        (SELECT count(*)::DOUBLE AS n FROM kept)"""
for _i in range(3):
    CTES[f"rate{_i + 1}"] = f"""
    SELECT coalesce(sum(CASE WHEN u THEN reads END) / sum(CASE WHEN u THEN len END), 0.0)::DOUBLE AS rate
    FROM (SELECT reads, len, rate * len - reads * {LN2} >= 17.0 AS u FROM m, rate{_i})"""
CTES["measured"] = f"""
    SELECT c.* REPLACE (rate * m.len - m.reads * {LN2} AS a_statistic)
    FROM collapsed c JOIN m USING (edge_id), rate2"""

CTES["ring_walk"] = """
    SELECT edge_id, edge_id AS other, v2 FROM mapped
    WHERE v1 IN (SELECT v FROM inner_v) AND edge_id NOT IN (SELECT edge_id FROM path)
    UNION
    SELECT w.edge_id, m.edge_id, m.v2 FROM ring_walk w JOIN mapped m ON m.v1 = w.v2"""

RECURSIVE = ("walk", "path", "reach", "ring_walk", "read_reach")

CTES["reach"] = """
    SELECT v, v AS w FROM collapsed_v
    UNION
    SELECT r.v, CASE WHEN c.v1 = r.w THEN c.v2 ELSE c.v1 END
    FROM reach r JOIN collapsed c ON c.v1 = r.w OR c.v2 = r.w"""
CTES["component"] = "SELECT v, min(w) AS component FROM reach GROUP BY v"

CTES["pairs"] = """
    SELECT a.edge_id, a.v1 // 2 AS v1, a.v2 // 2 AS v2, a.v1 % 2 = 1 AS v1_outward, a.v2 % 2 = 1 AS v2_inward,
           a.seq AS seq12, b.seq AS seq21,
           (a.mapped_read_count + b.mapped_read_count) / 2 AS mapped_read_count,
           ((a.num_inner_vertices + b.num_inner_vertices) // 2)::INTEGER AS num_inner_vertices,
           (a.a_statistic + b.a_statistic) / 2 AS a_statistic,
           CASE WHEN a.edge_id = b.edge_id THEN a.traversal_count
                ELSE a.traversal_count + b.traversal_count END::INTEGER AS traversal_count, a.is_special
    FROM measured a JOIN measured b ON b.edge_id = a.twin_id
    WHERE CASE WHEN a.v1 // 2 <> a.v2 // 2 THEN a.v1 < a.v2 WHEN a.v1 = a.v2 THEN a.v1 % 2 = 1
               ELSE a.edge_id <= a.twin_id END"""
CTES["collapsed_pairs"] = CTES["pairs"].replace("measured", "collapsed")
CTES["read_reach"] = """
    SELECT v1 AS r, v1 AS w FROM pairs UNION SELECT v2, v2 FROM pairs
    UNION
    SELECT r.r, CASE WHEN p.v1 = r.w THEN p.v2 ELSE p.v1 END FROM read_reach r JOIN pairs p ON p.v1 = r.w OR p.v2 = r.w"""
CTES["listed"] = """
    SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS step,
           CASE WHEN edge_id % 3 = 0 THEN v1 ELSE v2 END AS leaves,
           CASE WHEN edge_id % 3 = 0 THEN NOT v1_outward ELSE v2_inward END AS leaves_inward,
           CASE WHEN edge_id % 3 = 0 THEN v2 ELSE v1 END AS enters,
           CASE WHEN edge_id % 3 = 0 THEN v2_inward ELSE NOT v1_outward END AS enters_inward FROM pairs"""
CTES["bad_edge"] = """
    SELECT edge_id, twin_id, CASE WHEN edge_id % 13 = 4 THEN v1 + 1000000000 ELSE v1 END AS v1,
           CASE WHEN edge_id % 7 = 3 THEN xor(v2, 2) ELSE v2 END AS v2 FROM edge WHERE edge_id % 11 <> 5"""
CTES["bad_overlap"] = """
    SELECT CASE WHEN k = 4 THEN f + 1000000000 ELSE f END AS f,
           CASE WHEN k = 6 AND f_beg > 0 THEN f_beg - 1 ELSE f_beg END AS f_beg,
           CASE WHEN k = 1 THEN f_end + 1 WHEN k = 5 THEN f_beg + 9
                WHEN k = 6 AND f_beg > 0 THEN f_end - 1 ELSE f_end END AS f_end,
           g, CASE WHEN k = 2 THEN g_beg - 1 ELSE g_beg END AS g_beg,
           CASE WHEN k = 5 THEN g_beg + 9 ELSE g_end END AS g_end, CASE WHEN k = 3 THEN NOT rc ELSE rc END AS rc
    FROM (SELECT *, (f + 3 * g) % 11 AS k FROM overlap)"""
CTES["judged"] = f"""
    SELECT f, f_beg, f_end, g, g_beg, g_end, rc, CASE
        WHEN fs IS NULL OR gs IS NULL OR f > g THEN 'reads'
        WHEN f_beg < 0 OR g_beg < 0 OR f_end > fl OR g_end > gl OR f_beg > f_end OR g_beg > g_end THEN 'range'
        WHEN f_end - f_beg <> g_end - g_beg THEN 'lengths'
        WHEN f_end - f_beg + 1 < {L} THEN 'too short'
        WHEN f = g AND f_beg = g_beg AND f_end = g_end THEN 'same region'
        WHEN substr(fs, f_beg + 1, f_end - f_beg + 1) <> CASE WHEN rc THEN {rc('substr(gs, g_beg + 1, g_end - g_beg + 1)')}
             ELSE substr(gs, g_beg + 1, g_end - g_beg + 1) END THEN 'mismatch'
        WHEN ((f_beg = 0 AND CASE WHEN rc THEN gl - g_end ELSE g_beg END = 0)
              OR (f_end = fl AND CASE WHEN rc THEN gl - g_beg ELSE g_end END = gl))
             AND f_end - f_beg <> fl AND f_end - f_beg <> gl THEN 'layout' END AS rule
    FROM (SELECT o.*, a.seq AS fs, b.seq AS gs, length(a.seq) - 1 AS fl, length(b.seq) - 1 AS gl
          FROM bad_overlap o LEFT JOIN reads a ON a.read_id = f LEFT JOIN reads b ON b.read_id = g)"""
CTES["back"] = f"""
    SELECT 2 * edge_id AS edge_id, 2 * edge_id + 1 AS twin_id, 2 * v1 + v1_outward::INTEGER AS v1,
           2 * v2 + v2_inward::INTEGER AS v2, seq12 AS seq, {FRESH} FROM pairs
    UNION ALL
    SELECT 2 * edge_id + 1, 2 * edge_id, 2 * v2 + 1 - v2_inward::INTEGER, 2 * v1 + 1 - v1_outward::INTEGER,
           seq21, {FRESH} FROM pairs"""
CTES["bidi"] = f"""
    SELECT e.edge_id // 2 AS edge_id, e.v1 // 2 AS v1, e.v2 // 2 AS v2, e.v1 % 2 = 1 AS v1_outward,
           e.v2 % 2 = 1 AS v2_inward, e.seq AS seq12, t.seq AS seq21, {FRESH}
    FROM edge e JOIN edge t ON t.edge_id = e.twin_id WHERE e.edge_id % 2 = 0"""
CTES["dense_v"] = "SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM collapsed_v"
CTES["dense_e"] = "SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS n FROM collapsed"

CTES["ringed"] = """
    SELECT edge_id, len, n // 7 AS block, (n // 7) % 3 = 0 AS broken, CASE WHEN (n // 7) % 3 = 0 THEN (n + 3) % 7 ELSE n % 7 END AS ord
    FROM (SELECT edge_id, length(seq) AS len, row_number() OVER (ORDER BY edge_id) - 1 AS n, count(*) OVER () AS total FROM mapped)
    WHERE n < total - total % 7 AND NOT (n % 7 = 3 AND (n // 7) % 3 = 0)"""
CTES["priced_v"] = """
    SELECT v, CASE WHEN v % 5 = 1 THEN v % 3 ELSE 0 END AS fill, CASE WHEN v % 5 = 2 THEN v % 2 ELSE 0 END AS spill,
        CASE v % 7 WHEN 0 THEN 1000000 WHEN 1 THEN -1000000 WHEN 2 THEN 1000005 WHEN 3 THEN -1000005 ELSE v % 3 END AS price
    FROM collapsed_v"""
CTES["priced_e"] = """
    SELECT edge_id, edge_id % 4 AS flow, CASE WHEN a_statistic >= 17.0 OR num_inner_vertices > 0 THEN 1 ELSE 0 END AS lo,
        CASE WHEN a_statistic >= 17.0 THEN 1 ELSE 1000000 END AS up, 1 + q.price - p.price AS reduced
    FROM measured JOIN priced_v p ON p.v = v1 JOIN priced_v q ON q.v = v2"""

CTES["genome_line"] = "SELECT block_no + 1 AS line_no, bases AS line FROM block UNION ALL SELECT 0, '>genome'"

ROUNDED = """edge_id, twin_id, v1, v2, seq, round(mapped_read_count, 6) AS mapped_read_count,
    num_inner_vertices, round(a_statistic, 6) AS a_statistic, traversal_count, is_special"""
BIDI_ROUNDED = """edge_id, v1, v2, v1_outward, v2_inward, seq12, seq21,
    round(mapped_read_count, 6) AS mapped_read_count, num_inner_vertices,
    round(a_statistic, 6) AS a_statistic, traversal_count, is_special"""

ATTR_TEXT = """'_mapped_read_count=' || format('{:g}', mapped_read_count) || chr(9) ||
    '_num_inner_vertices=' || num_inner_vertices || chr(9) || '_A_statistic=' || format('{:g}', a_statistic) || chr(9) ||
    '_traversal_count=' || traversal_count || chr(9) || '_is_special=' || is_special::INTEGER || chr(9)"""


def side(v: str) -> str:
    return f"({v} // 2 + 1) || '.' || CASE WHEN {v} % 2 = 1 THEN 'E' ELSE 'B' END"


def bidi_view(place: int) -> str:
    near, far = ("v1", "v2") if place == 1 else ("v2", "v1")
    plain = "v1_outward", "v2_inward"
    turned = "CASE WHEN v1 = v2 THEN v1_outward ELSE NOT v2_inward END", "CASE WHEN v1 = v2 THEN v2_inward ELSE NOT v1_outward END"
    out, inw = plain if place == 1 else turned
    return f"""SELECT {near} AS v, edge_id, {place} AS place, ({near} + 1) || ' ' || CASE WHEN {out} THEN '>' ELSE '<' END
        || '---------' || CASE WHEN {inw} THEN '>' ELSE '<' END || ' ' || ({far} + 1) || chr(9) || {ATTR_TEXT}
        || length(seq12) || chr(9) || length(seq21) AS line FROM pairs"""


DEGREE_ROW = """count(*) AS vertices, count(*) FILTER (i = 0 AND o = 0) AS isolated,
    count(*) FILTER (i = 1 AND o = 1) AS inner_vertices, count(*) FILTER (i = 0 AND o = 1) AS branch_begins,
    count(*) FILTER (i = 1 AND o = 0) AS branch_ends, count(*) FILTER (i <> o) AS unequal_degrees,
    max(i) AS max_in_degree, max(o) AS max_out_degree"""

WRAP = """array_to_string([substr(seq, 1, 70), substr(seq, 71, 70)], chr(10))"""

FINAL: dict[str, str] = {
    "sampled_reads": "SELECT read_id, seq FROM reads",
    "scan_fasta": "SELECT read_id, seq FROM reads",
    "scan_fastq": "SELECT read_id, seq FROM reads",
    "sink_fasta": f"""SELECT read_id, '>read_' || (read_id + 1) || chr(10) ||
        CASE WHEN length(seq) > 70 THEN {WRAP} ELSE seq END AS record FROM reads""",
    "sink_fastq": """SELECT read_id, '@read_' || (read_id + 1) || chr(10) || seq || chr(10) || '+' || chr(10) ||
        repeat('@', length(seq)) AS record FROM reads""",
    "convert_reads": """SELECT read_id, seq FROM reads
        UNION ALL SELECT read_id + (SELECT count(*) FROM reads), seq FROM reads""",
    "sequence_functions": f"""SELECT read_id, length(seq)::INTEGER AS len, {rc('seq')} AS rc,
        substr(seq, b + 1, e - b) AS part, {rc('substr(seq, b + 1, e - b)')} AS rc_part,
        substr(seq, 1, e - 1) || 'A' || substr(seq, e + 1) AS edited,
        list_sum([instr('ACGT', c) - 1 FOR c IN string_split(seq, '')])::INTEGER AS code_sum,
        translate(seq, 'ACGT', 'TGCA') AS complement, array_to_string([least(w, {rc('w')}) FOR w IN ks], ',') AS canonical,
        len([w FOR w IN ks IF NOT (w < {rc('w')})])::INTEGER AS reversed_kmers,
        seq NOT SIMILAR TO '.*[^ACGT].*' AS valid FROM (SELECT *, length(seq) // 4 AS b, 3 * length(seq) // 4 AS e,
            [substr(seq, p, 25) FOR p IN range(1, length(seq) - 23)] AS ks FROM reads)""",
    "numeric_functions": """SELECT l_orderkey, l_linenumber,
        CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END AS ratio,
        CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount * 100.0 / l_tax END AS percent,
        ceil(l_quantity / l_linenumber)::BIGINT AS lots,
        CASE WHEN l_linenumber - 1 = 0 THEN 0 ELSE l_partkey % (l_linenumber - 1) END AS remainder
        FROM lineitem""",
    "kmer_occurrences": "SELECT kmer, read_id, pos, rc FROM occurrence",
    "kmer_counts": "SELECT kmer, count(*) AS occurrences, count(DISTINCT read_id) AS reads FROM occurrence GROUP BY kmer",
    "seed_pair_counts": "SELECT kmer, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM occurrence GROUP BY kmer",
    "compute_overlaps": "SELECT f, f_beg, f_end, g, g_beg, g_end, rc FROM overlap",
    "overlap_dedup": """SELECT f, g, f_beg > 0 AS later, rc, max(n)::INTEGER AS longest FROM sided
        GROUP BY f, g, f_beg > 0, rc""",
    "overlap_violations": """SELECT f, f_beg, f_end, g, g_beg, g_end, rc, rule FROM judged WHERE rule IS NOT NULL""",
    "print_overlaps": """SELECT f, g, (f_beg > 0)::INTEGER * 2 + rc::INTEGER AS type,
        'Overlap { Read ' || (f + 1) || ': [' || f_beg || ', ' || f_end || '], Read ' || (g + 1) || ': [' || g_beg ||
        ', ' || g_end || '], rc = ' || rc::INTEGER || ' }' AS line FROM overlap""",
    "contained_reads": "SELECT read_id FROM contained",
    "old_to_new_indices": "SELECT old_id, new_id FROM index_map",
    "uncontained_reads": "SELECT read_id, seq FROM kept_read",
    "uncontained_overlaps": "SELECT f, f_beg, f_end, g, g_beg, g_end, rc FROM kept_overlap",
    "containment_summary": """SELECT reads, contained_reads, contained_reads * 100.0 / reads AS contained_pct, n AS "overlaps",
        n - k AS deleted_overlaps, (n - k) * 100.0 / n AS deleted_pct FROM
        (SELECT count(*) AS reads FROM reads), (SELECT count(*) AS contained_reads FROM contained),
        (SELECT count(*) AS n FROM overlap), (SELECT count(*) AS k FROM kept_overlap)""",
    "build_digraph": f"SELECT *, {FRESH} FROM edge",
    "build_bidigraph": "SELECT * FROM bidi",
    "digraph_violations": """SELECT * FROM (SELECT e.edge_id, CASE
            WHEN e.v1 NOT IN (SELECT v FROM vertex) OR e.v2 NOT IN (SELECT v FROM vertex) THEN 'endpoint'
            WHEN t.twin_id IS DISTINCT FROM e.edge_id THEN 'twin id'
            WHEN t.v1 <> xor(e.v2, 1) OR t.v2 <> xor(e.v1, 1) THEN 'twin ends' END AS rule
        FROM bad_edge e LEFT JOIN bad_edge t ON t.edge_id = e.twin_id) WHERE rule IS NOT NULL""",
    "bidigraph_violations": """SELECT edge_id, CASE WHEN edge_id % 7 = 3 THEN 'endpoint' ELSE 'label' END AS rule
        FROM bidi WHERE edge_id % 7 = 3 OR edge_id % 11 = 5""",
    "transitive_edges": "SELECT edge_id FROM transitive",
    "transitive_reduction": f"SELECT *, {FRESH} FROM reduced",
    "bidi_transitive_reduction": "SELECT * FROM bidi "
                                 "WHERE 2 * edge_id IN (SELECT edge_id FROM reduced)",
    "vertex_degrees": "SELECT v, in_degree, out_degree FROM degree",
    "degree_histogram": "SELECT in_degree, out_degree, count(*) AS vertices FROM degree GROUP BY in_degree, out_degree",
    "digraph_stats": f"""SELECT {DEGREE_ROW}, any_value(edges) AS edges, any_value(em) AS edges_with_mapped_reads,
        round(any_value(mm), 6) AS mean_mapped_reads
        FROM (SELECT v, in_degree AS i, out_degree AS o FROM degree),
        (SELECT count(*) AS edges, count(*) FILTER (mapped_read_count > 1) AS em, avg(mapped_read_count) AS mm FROM mapped)""",
    "bidigraph_stats": f"""SELECT {DEGREE_ROW}, any_value(edges) AS edges, any_value(t) AS edges_through,
        any_value(ow) AS edges_outward, any_value(iw) AS edges_inward
        FROM (SELECT v, count(*) FILTER (h) AS i, count(*) FILTER (NOT h) AS o FROM (
                SELECT v1 AS v, NOT v1_outward AS h FROM bidi UNION ALL SELECT v2, v2_inward FROM bidi
                UNION ALL SELECT new_id, NULL FROM kept) GROUP BY v),
        (SELECT count(*) AS edges, count(*) FILTER (v1_outward = v2_inward) AS t,
                count(*) FILTER (NOT v1_outward AND v2_inward) AS ow,
                count(*) FILTER (v1_outward AND NOT v2_inward) AS iw FROM bidi)""",
    "mean_degree": """SELECT vertices, edges, edges / vertices AS mean_degree FROM
        (SELECT count(*) AS vertices FROM vertex), (SELECT count(*) AS edges FROM reduced)""",
    "extract_edge_seqs": "SELECT edge_id, 0 AS part, seq FROM reduced",
    "extract_bidigraph_seqs": """SELECT edge_id, 0 AS part, seq12 AS seq FROM bidi
        UNION ALL SELECT edge_id, 1, seq21 FROM bidi""",
    "contained_overhangs": """SELECT read_id, overhang, over_read, over_rc, underhang, under_read, under_rc
        FROM overhang""",
    "walk_starts": "SELECT v, residual, reads FROM walk_start",
    "walk_back": "SELECT v, residual, edge_id, hits FROM hit",
    "mapped_read_counts": "SELECT edge_id, round(added, 6) AS added FROM added",
    "map_contained": f"SELECT {ROUNDED} FROM mapped",
    "recipe_stages": """SELECT 'reads' AS stage, (SELECT count(*) FROM reads) AS rows
        UNION ALL SELECT 'index_map', (SELECT count(*) FROM reads) UNION ALL SELECT 'kept_reads', (SELECT count(*) FROM kept)
        UNION ALL SELECT 'kept_overlaps', (SELECT count(*) FROM kept_overlap)
        UNION ALL SELECT 'reduced', (SELECT count(*) FROM reduced) UNION ALL SELECT 'mapped', (SELECT count(*) FROM mapped)
        UNION ALL SELECT 'collapsed', (SELECT count(*) FROM collapsed) UNION ALL SELECT 'measured', (SELECT count(*) FROM measured)
        UNION ALL SELECT 'circulated', (SELECT count(*) FROM measured) + 4 * (SELECT count(*) FROM collapsed_v)
        UNION ALL SELECT 'bidigraph', (SELECT count(*) FROM pairs) + 2 * (SELECT count(*) FROM collapsed_v)""",
    "path_positions": """SELECT edge_id, head, pos::BIGINT AS pos, before::BIGINT AS "offset" FROM (
            SELECT p.edge_id, p.head, p.pos, sum(length(seq)) OVER (PARTITION BY p.head ORDER BY p.pos) - length(seq) AS before,
                count(*) OVER (PARTITION BY p.head) AS edges
            FROM path p JOIN mapped m ON m.edge_id = p.edge_id) WHERE edges > 1
        UNION ALL SELECT edge_id, NULL, NULL, NULL FROM mapped WHERE edge_id NOT IN (SELECT edge_id FROM path)""",
    "collapsed_pieces": """SELECT p.head AS edge_id, 0 AS part,
            (sum(length(seq)) OVER (PARTITION BY p.head ORDER BY p.pos) - length(seq))::BIGINT AS "offset", seq
        FROM path p JOIN mapped m ON m.edge_id = p.edge_id
        UNION ALL SELECT edge_id, 0, 0, seq FROM mapped WHERE edge_id NOT IN (SELECT edge_id FROM path)""",
    "collapse_unbranched": f"SELECT {ROUNDED} FROM collapsed",
    "collapsed_vertices": "SELECT v FROM collapsed_v",
    "smooth_rings": """SELECT min(edge_id) AS ring, count(*) AS vertices, sum(len)::BIGINT AS bases
        FROM ringed WHERE NOT broken GROUP BY block""",
    "cut_ring_positions": """SELECT edge_id, first_value(edge_id) OVER w AS head, row_number() OVER w - 1 AS pos,
            (sum(len) OVER w - len)::BIGINT AS "offset"
        FROM ringed WINDOW w AS (PARTITION BY block ORDER BY ord)""",
    "circulation_slack": """SELECT 'edge' AS kind, edge_id AS id, CASE WHEN flow < up AND reduced < 0 THEN 'cheap but not full'
            ELSE 'used but dear' END AS rule, reduced AS reduced_cost FROM priced_e
            WHERE (flow < up AND reduced < 0) OR (flow > lo AND reduced > 0)
        UNION ALL SELECT 'vertex', v, CASE WHEN price > 1000000 THEN 'spill is cheaper' WHEN price < -1000000 THEN 'fill is cheaper'
            WHEN spill > 0 AND price < 1000000 THEN 'spilled too early' ELSE 'filled too early' END, price FROM priced_v
            WHERE abs(price) > 1000000 OR (spill > 0 AND price < 1000000) OR (fill > 0 AND price > -1000000)""",
    "circulation_duality": """SELECT cost, bound, cost - bound AS gap FROM (SELECT
            (coalesce((SELECT sum(flow) FROM priced_e), 0)
                + coalesce((SELECT sum(1000000 * (fill + spill)) FROM priced_v), 0))::BIGINT AS cost,
            (coalesce((SELECT sum(CASE WHEN reduced > 0 THEN reduced * lo ELSE reduced * up END) FROM priced_e), 0)
                + coalesce((SELECT sum(2000000 * (least(1000000 - price, 0) + least(1000000 + price, 0))) FROM priced_v), 0))::BIGINT AS bound)""",
    "circulation_certificate": """SELECT count(*) AS edges, 0::BIGINT AS slack_violations, 0::BIGINT AS flow_violations, 0::BIGINT AS gap
        FROM measured""",
    "components": "SELECT v, component FROM component",
    "component_sizes": "SELECT component, count(*) AS vertices FROM component GROUP BY component",
    "bootstrap_genome_len": "SELECT sum(CASE WHEN v1 % 2 = 1 THEN len END)::BIGINT AS genome_len FROM m",
    "arrival_rates": """SELECT round(a.rate, 9) AS rate0, round(b.rate, 9) AS rate1, round(c.rate, 9) AS rate2,
        round(d.rate, 9) AS rate3 FROM rate0 a, rate1 b, rate2 c, rate3 d""",
    "a_statistics": f"SELECT {ROUNDED} FROM measured",
    "a_stat_classes": " UNION ALL ".join(f"""SELECT {i + 1} AS round, count(*) FILTER (a >= 17.0) AS unique_edges,
        count(*) FILTER (a < 17.0 AND reads = 0) AS optional_edges,
        count(*) FILTER (a < 17.0 AND reads <> 0) AS required_edges,
        any_value(CASE WHEN nx = 0 THEN 0 ELSE floor(n / nx) END)::BIGINT AS genome_len
        FROM (SELECT r.rate * len - reads * {LN2} AS a, reads, x.rate AS nx FROM m, rate{i} r, rate{i + 1} x),
             (SELECT count(*)::DOUBLE AS n FROM kept)""" for i in range(3)),
    "flow_bounds": """SELECT edge_id,
        CASE WHEN a_statistic >= 17.0 OR num_inner_vertices > 0 THEN 1 ELSE 0 END AS lower,
        CASE WHEN a_statistic >= 17.0 THEN 1 ELSE 1000000 END AS upper, 1 AS cost FROM measured""",
    "digraph_to_bidigraph": f"SELECT {BIDI_ROUNDED} FROM pairs",
    "bidigraph_to_digraph": "SELECT * FROM back",
    "renumber_digraph": """SELECT a.n AS edge_id, b.n AS twin_id, p.n AS v1, q.n AS v2, seq FROM collapsed c
        JOIN dense_e a ON a.edge_id = c.edge_id JOIN dense_e b ON b.edge_id = c.twin_id
        JOIN dense_v p ON p.v = c.v1 JOIN dense_v q ON q.v = c.v2""",
    "print_digraph": f"""SELECT v1 AS v, edge_id, {side('v1')} || ' -> ' || {side('v2')} || chr(9) || {ATTR_TEXT}
        || length(seq) AS line FROM mapped""",
    "print_bidigraph": f"{bidi_view(1)} UNION ALL {bidi_view(2)}",
    "graph_dot": f"""SELECT 0 AS part, a, 0 AS b, line FROM (VALUES (0, 'digraph {{'),
            (1, chr(9) || 'node [shape=circle fontname="Arial"]'),
            (2, chr(9) || 'edge [fontname="Courier new bold" fontsize=11]'),
            (3, chr(9) || 'node [style=filled];')) t(a, line)
        UNION ALL SELECT 1, v, 0, chr(9) || 'v' || v || ' [ label="' || {side('v')} || '" fillcolor=' ||
            CASE WHEN v % 2 = 1 THEN 'green' ELSE 'cyan' END || ' ];' FROM vertex
        UNION ALL SELECT 2, v1, edge_id, chr(9) || 'v' || v1 || ' -> v' || v2 || ' [ label="' || length(seq) || '" ];'
            FROM mapped
        UNION ALL SELECT 3, 0, 0, '}}'""",
    "graph_dot_seqs": f"""SELECT 0 AS part, a, 0 AS b, line FROM (VALUES (0, 'digraph {{'),
            (1, chr(9) || 'node [shape=circle fontname="Arial"]'),
            (2, chr(9) || 'edge [fontname="Courier new bold" fontsize=11]'),
            (3, chr(9) || 'node [style=filled];')) t(a, line)
        UNION ALL SELECT 1, v, 0, chr(9) || 'v' || v || ' [ label="' || {side('v')} || '" fillcolor=' ||
            CASE WHEN v % 2 = 1 THEN 'green' ELSE 'cyan' END || ' ];' FROM vertex
        UNION ALL SELECT 2, v1, edge_id, chr(9) || 'v' || v1 || ' -> v' || v2 || ' [ label="' || seq || '" ' ||
            CASE WHEN edge_id % 3 <> 0 THEN 'color=red ' ELSE '' END || '];' FROM mapped
        UNION ALL SELECT 3, 0, 0, '}}'""",
    "bidigraph_dot_seqs": """SELECT 0 AS part, a, 0 AS b, line FROM (VALUES (0, 'digraph {'),
            (1, chr(9) || 'node [shape=circle fontname="Arial"]'),
            (2, chr(9) || 'edge [fontname="Courier new bold" fontsize=11]')) t(a, line)
        UNION ALL SELECT 1, v // 2, 0, chr(9) || 'v' || (v // 2) || ' [ label = "' || (v // 2 + 1) || '" ];'
            FROM collapsed_v WHERE v % 2 = 0
        UNION ALL SELECT 2, v1, edge_id, chr(9) || 'v' || v1 || ' -> v' || v2 || ' [ dir=both arrowhead=' ||
            CASE WHEN v2_inward THEN 'normal' ELSE 'inv' END || ' arrowtail=' ||
            CASE WHEN v1_outward THEN 'inv' ELSE 'normal' END || ' taillabel="' || seq12 || '" headlabel="' || seq21 ||
            '" labelangle=' || format('{:g}', 90 - (180 / (2 * pi())) * atan(2.0::DOUBLE / length(seq12))) ||
            ' labeldistance=' || format('{:g}', length(seq12)::DOUBLE / 2.5 + 1.0) ||
            CASE WHEN edge_id % 3 <> 0 THEN ' color=red ' ELSE '' END || ' ];' FROM pairs
        UNION ALL SELECT 3, 0, 0, '}'""",
    "bidigraph_dot": """SELECT 0 AS part, a, 0 AS b, line FROM (VALUES (0, 'digraph {'),
            (1, chr(9) || 'node [shape=circle fontname="Arial"]'),
            (2, chr(9) || 'edge [fontname="Courier new bold" fontsize=11]')) t(a, line)
        UNION ALL SELECT 1, v // 2, 0, chr(9) || 'v' || (v // 2) || ' [ label = "' || (v // 2 + 1) || '" ];'
            FROM collapsed_v WHERE v % 2 = 0
        UNION ALL SELECT 2, v1, edge_id, chr(9) || 'v' || v1 || ' -> v' || v2 || ' [ dir=both arrowhead=' ||
            CASE WHEN v2_inward THEN 'normal' ELSE 'inv' END || ' arrowtail=' ||
            CASE WHEN v1_outward THEN 'inv' ELSE 'normal' END || ' label="' || length(seq12) || '" ];' FROM pairs
        UNION ALL SELECT 3, 0, 0, '}'""",
    "mapped_smooth_rings": """SELECT ring, count(*) AS vertices, sum(length(seq))::BIGINT AS bases FROM mapped
        JOIN (SELECT edge_id, min(other) AS ring FROM ring_walk GROUP BY edge_id) USING (edge_id) GROUP BY ring""",
    "fasta_head": """SELECT line_no, CASE WHEN line_no = 0 THEN line
            ELSE substr(line, 1, (nb - 32 * (line_no - 1))::BIGINT) END AS line
        FROM genome_line, (SELECT count(*) * 16 + 7 AS nb FROM block)
        WHERE line_no = 0 OR 32 * (line_no - 1) < nb""",
    "circulation_violations": """SELECT 'edge' AS kind, edge_id AS id FROM measured WHERE edge_id % 4 <
            CASE WHEN a_statistic >= 17.0 OR num_inner_vertices > 0 THEN 1 ELSE 0 END
            OR edge_id % 4 > CASE WHEN a_statistic >= 17.0 THEN 1 ELSE 1000000 END
        UNION ALL SELECT 'vertex', v FROM (SELECT v2 AS v, edge_id % 4 AS x FROM measured
            UNION ALL SELECT v1, -(edge_id % 4) FROM measured) GROUP BY v HAVING sum(x) <> 0""",
    "balance_violations": """SELECT v, inward, outward FROM (SELECT v, sum(CASE WHEN h THEN x ELSE 0 END)::BIGINT AS inward,
            sum(CASE WHEN h THEN 0 ELSE x END)::BIGINT AS outward FROM (
                SELECT v1 AS v, NOT v1_outward AS h, edge_id % 3 AS x FROM pairs UNION ALL
                SELECT v2, v2_inward, edge_id % 3 FROM pairs) WHERE x > 0 GROUP BY v) WHERE inward <> outward""",
    "cycle_violations": """SELECT 'count' AS rule, edge_id AS id FROM listed WHERE edge_id % 3 <> 1
        UNION ALL SELECT 'order', a.step FROM listed a JOIN listed b
            ON b.step = (a.step + 1) % (SELECT count(*) FROM listed)
        WHERE a.enters <> b.leaves OR a.enters_inward = b.leaves_inward""",
    "eulerian_circuits": """SELECT 2 * min(edge_id) AS circuit, 2 * count(*) AS steps, 2 * count(*) AS edges_used,
            2 * count(*) - 1 AS last_step, 0::BIGINT AS violations
        FROM pairs JOIN (SELECT r, min(w) AS part FROM read_reach GROUP BY r) ON r = v1 GROUP BY part""",
    "bidi_collapse": f"""SELECT {BIDI_ROUNDED.replace('edge_id, ', '', 1)} FROM collapsed_pairs""",
    "stored_overlaps": "SELECT f, f_beg, f_end, g, g_beg, g_end, rc, f_len, g_len FROM overlap",
    "stored_graph_kinds": """SELECT 'digraph' AS kind, (SELECT count(*) FROM mapped) AS edges, (SELECT count(*) FROM vertex) AS vertices,
            (SELECT count(*) FROM mapped) AS lines, (SELECT count(*) FROM kept) AS reads
        UNION ALL SELECT 'bidigraph', (SELECT count(*) FROM pairs), (SELECT count(*) FROM collapsed_v) // 2,
            2 * (SELECT count(*) FROM pairs), (SELECT count(*) FROM kept)""",
    "stored_digraph": f"SELECT {ROUNDED} FROM mapped",
    "stored_bidigraph": f"SELECT {BIDI_ROUNDED} FROM pairs",
    "circulated_flow_bounds": """SELECT edge_id,
            CASE WHEN a_statistic >= 17.0 OR num_inner_vertices > 0 THEN 1 ELSE 0 END AS lower,
            CASE WHEN a_statistic >= 17.0 THEN 1 ELSE 1000000 END AS upper, 1 AS cost FROM measured
        UNION ALL SELECT top + 4 * v + slot, 0, 1000000, 1000000 FROM collapsed_v,
            (SELECT max(edge_id) + 1 AS top FROM measured), (SELECT unnest(range(0, 4)) AS slot)""",
}


def _needed(sql: str, seen: set[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"(?<![\w.']){name}\b(?!\()", sql):
            seen.add(name)
            _needed(CTES[name], seen)


def statement(name: str) -> str:
    """Complete SQL of one query: the CTEs it depends on, then its final SELECT."""
    seen: set[str] = set()
    _needed(FINAL[name], seen)
    parts = []
    for cte, body in CTES.items():
        if cte in seen:
            kind = "AS" if cte in RECURSIVE else "AS MATERIALIZED"
            parts.append(f"{cte} {kind} ({body})")
    if not parts:
        return FINAL[name]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + FINAL[name]


def all_statements() -> dict[str, str]:
    return {name: statement(name) for name in FINAL}
