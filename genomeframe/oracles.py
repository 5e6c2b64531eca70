"""Equivalent SQL for the registered queries, for a second engine to check."""

from __future__ import annotations

EXONS = """ex AS (
 SELECT side, l_orderkey // 2 AS gid, l_orderkey AS tid,
  CAST((l_orderkey // 2) % 16 AS VARCHAR) AS seqid,
  CASE WHEN (l_orderkey // 32) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE WHEN l_returnflag <> 'N' THEN 'CDS' ELSE 'exon' END AS kind,
  l_partkey * 50 + l_linenumber AS start0,
  l_partkey * 50 + l_linenumber + CAST(l_quantity AS BIGINT)
   + CASE WHEN side = 1 AND l_discount >= 0.08 THEN 3 ELSE 0 END AS end0
 FROM lineitem, (VALUES (0), (1)) s(side))"""

REGIONS = """regions AS (
 SELECT CAST(o_custkey % 16 AS VARCHAR) AS seqid,
  CASE WHEN (o_custkey // 16) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  (o_orderkey * 37) % 100000 AS start0, (o_orderkey * 37) % 100000 + 500 AS end0
 FROM orders)"""

TRAINING = """tr AS (
 SELECT CAST((l_orderkey // 2) % 16 AS VARCHAR) AS seqid,
  CASE WHEN (l_orderkey // 32) % 2 = 0 THEN '+' ELSE '-' END AS strand, l_orderkey AS tid,
  CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'R' THEN 'five_prime_UTR' ELSE 'exon' END AS kind,
  l_partkey * 50 + l_linenumber AS start0,
  l_partkey * 50 + l_linenumber + CAST(l_quantity AS BIGINT) AS end0
 FROM lineitem)"""


def merged(name: str, source: str, keys: str) -> str:
    """CTEs that merge overlapping and touching intervals of ``source`` per key."""
    return f"""{name}_a AS (SELECT {keys}, start0, end0, max(end0) OVER (PARTITION BY {keys}
  ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT {keys}, start0, end0 FROM {source})),
{name}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 > reach THEN 1 ELSE 0 END) OVER
  (PARTITION BY {keys} ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT {keys}, min(start0) AS start0, max(end0) AS end0 FROM {name}_b
  GROUP BY {keys}, island)"""


def gaps(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, end0 AS start0, nxt AS end0 FROM (SELECT {keys}, end0,
  lead(start0) OVER (PARTITION BY {keys} ORDER BY start0, end0) AS nxt FROM {source})
  WHERE nxt > end0)"""


TX = "side, gid, tid, seqid, strand"
TT = "seqid, strand, tid"

SPANS = (
    EXONS
    + """,
pref AS (SELECT * FROM (SELECT *, bool_or(kind = 'CDS') OVER (PARTITION BY side, tid) AS p FROM ex)
 WHERE kind = 'CDS' OR NOT p),
"""
    + merged("spans", "pref", TX)
)
CHAINS = (
    SPANS
    + f""",
chains AS (SELECT {TX}, list({{'a': start0, 'b': end0}} ORDER BY start0) AS chain,
 count(*) AS n_spans, min(start0) AS start0, max(end0) AS end0, CAST(sum(end0 - start0) AS BIGINT) AS bases
 FROM spans GROUP BY {TX})"""
)
INTRONS = SPANS + ",\n" + gaps("introns", "spans", TX)

TSPANS = (
    TRAINING
    + f""",
tp AS (SELECT * FROM (SELECT *, bool_or(kind = 'exon') OVER (PARTITION BY {TT}) AS p FROM tr)
 WHERE (kind = 'exon' OR NOT p) AND kind IN ('exon', 'CDS')),
"""
    + merged("tspans", "tp", TT)
)
TPAIRS = (
    TSPANS
    + f""",
tbounds AS (SELECT {TT}, min(start0) AS start0, max(end0) AS end0 FROM tspans GROUP BY {TT}),
{gaps("tintrons", "tspans", TT)}"""
)

ALTERNATIVES = (
    CHAINS
    + """,
forms AS (SELECT DISTINCT side, gid, seqid, strand, chain, start0, end0 FROM chains),
several AS (SELECT side, gid, seqid, strand FROM forms GROUP BY ALL HAVING count(*) > 1),
alts AS (SELECT DISTINCT side, seqid, strand, chain, start0, end0 FROM forms
 SEMI JOIN several USING (side, gid, seqid, strand)),
"""
    + merged("altregions", "alts", "seqid, strand")
)


def report(base: str) -> str:
    """The nine metrics from a CTE list that defines spans, chains and altregions."""
    return f"""WITH {base},
{gaps("introns", "spans", TX)},
items AS (
 SELECT DISTINCT side, 'exon-segment' AS metric, seqid, strand, start0 AS x, end0 AS y, NULL AS chain FROM spans
 UNION ALL SELECT DISTINCT side, 'intron-segment', seqid, strand, start0, end0, NULL FROM introns
 UNION ALL SELECT DISTINCT side, 'donor-site', seqid, strand,
  CASE WHEN strand = '+' THEN start0 + 1 ELSE end0 END, 0, NULL FROM introns
 UNION ALL SELECT DISTINCT side, 'acceptor-site', seqid, strand,
  CASE WHEN strand = '+' THEN end0 ELSE start0 + 1 END, 0, NULL FROM introns
 UNION ALL SELECT DISTINCT side, 'start-site', seqid, strand,
  CASE WHEN strand = '+' THEN start0 + 1 ELSE end0 END, 0, NULL FROM chains
 UNION ALL SELECT DISTINCT side, 'stop-site', seqid, strand,
  CASE WHEN strand = '+' THEN end0 ELSE start0 + 1 END, 0, NULL FROM chains
 UNION ALL SELECT DISTINCT side, 'transcript-CDS-chain', seqid, strand, start0, end0, CAST(chain AS VARCHAR) FROM chains
 UNION ALL SELECT DISTINCT c.side, 'alternative-isoform', c.seqid, c.strand, c.start0, c.end0, CAST(c.chain AS VARCHAR)
  FROM chains c SEMI JOIN altregions r ON c.seqid = r.seqid AND c.strand = r.strand
   AND r.start0 < c.end0 AND c.start0 < r.end0),
found AS (SELECT metric, seqid, strand, x, y, chain, bool_or(side = 0) AS r, bool_or(side = 1) AS p
 FROM items GROUP BY ALL),
counts AS (SELECT metric, count(*) FILTER (r AND p) AS tp, count(*) FILTER (NOT r AND p) AS fp,
 count(*) FILTER (r AND NOT p) AS fn FROM found GROUP BY metric
 UNION ALL SELECT 'nt', shared, covered1 - shared, covered0 - shared FROM ({OVERLAP_SELECT.format(source="spans")})),
full_report AS (SELECT metric, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
 CAST(tp + fn AS BIGINT) AS reference, CAST(tp + fp AS BIGINT) AS prediction,
 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn > 0 THEN 0.0 END AS precision,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM counts)"""


OVERLAP_SELECT = """SELECT
  CAST(sum(len) FILTER (c0 > 0) AS BIGINT) AS covered0,
  CAST(sum(len) FILTER (c1 > 0) AS BIGINT) AS covered1,
  CAST(sum(len) FILTER (c0 > 0 AND c1 > 0) AS BIGINT) AS shared
 FROM (SELECT sum(d0) OVER w AS c0, sum(d1) OVER w AS c1, lead(pos) OVER w - pos AS len
  FROM (SELECT seqid, strand, pos, sum(d0) AS d0, sum(d1) AS d1 FROM (
    SELECT seqid, strand, start0 AS pos, (side = 0)::INT AS d0, (side = 1)::INT AS d1 FROM {source}
    UNION ALL SELECT seqid, strand, end0, -(side = 0)::INT, -(side = 1)::INT FROM {source})
   GROUP BY ALL)
  WINDOW w AS (PARTITION BY seqid, strand ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

RATES = "metric, tp, fp, fn, reference, prediction, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"

# Sequences ------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 7)[:26] * 2
CONTIGS = f"""contigs AS (SELECT seqid, ord, bases, length(bases) AS length FROM (
 SELECT CAST(doc_id AS VARCHAR) AS seqid, CAST(doc_id AS INTEGER) AS ord,
  regexp_replace(translate(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g'), '{_LETTERS}', '{_BASES}'),
   '[^ACGT]', 'N', 'g') AS bases FROM documents) WHERE length(bases) > 0)"""
PLACED = (
    CONTIGS
    + """,
n AS (SELECT count(*) AS n FROM documents),
placed AS (SELECT 't' || l_orderkey AS tid, c.seqid,
  CASE WHEN (l_orderkey // n.n) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE WHEN l_returnflag = 'A' THEN 'CDS' ELSE 'exon' END AS kind,
  (l_partkey * 37 + l_linenumber * 11) % c.length AS start0,
  least((l_partkey * 37 + l_linenumber * 11) % c.length + CAST(l_quantity AS BIGINT) * 3, c.length) AS end0,
  c.length
 FROM lineitem, n, contigs c WHERE c.seqid = CAST(l_orderkey % n.n AS VARCHAR))"""
)


def orfs(name: str, source: str) -> str:
    """CTEs with the longest reading frame of ``source(id, bases)``: id, start, stop."""
    return f"""{name}_c AS (SELECT id, unnest(range(length(bases))) AS p, unnest(string_split(bases, '')) AS b
  FROM {source} WHERE length(bases) > 2),
{name}_k AS (SELECT id, p, p % 3 AS f, b || lead(b) OVER w || lead(b, 2) OVER w AS codon FROM {name}_c
  WINDOW w AS (PARTITION BY id ORDER BY p)),
{name}_s AS (SELECT id, p, f, codon,
  codon IN ('TAA', 'TAG', 'TGA') AS stops, codon LIKE '%N%' AS unknown FROM {name}_k),
{name}_g AS (SELECT *, coalesce(sum((stops OR unknown)::INT) OVER (PARTITION BY id, f ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM {name}_s),
{name}_o AS (SELECT id, min(p) FILTER (codon = 'ATG') AS start, max(p + 3) FILTER (stops) AS stop
  FROM {name}_g GROUP BY id, f, seg),
{name} AS (SELECT id, start, stop FROM {name}_o WHERE start IS NOT NULL AND stop IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY stop - start DESC, start) = 1)"""


FORMS = (
    PLACED
    + ",\n"
    + merged("mexons", "placed", "tid, seqid, strand")
    + """,
oriented AS (SELECT tid, m.seqid, m.strand, bases, c.length,
  CASE WHEN m.strand = '+' THEN start0 ELSE c.length - end0 END AS s,
  CASE WHEN m.strand = '+' THEN end0 ELSE c.length - start0 END AS e
 FROM mexons m JOIN contigs c USING (seqid)),
pieces AS (SELECT tid, s, e, CASE WHEN strand = '+' THEN bases[s + 1 : e]
  ELSE reverse(translate(bases[length - e + 1 : length - s], 'ACGT', 'TGCA')) END AS piece FROM oriented),
spliced AS (SELECT tid AS id, string_agg(piece, '' ORDER BY s) AS bases FROM pieces GROUP BY tid),
"""
    + orfs("torf", "spliced")
)

ORACLES = {
    "interval_merge": f"WITH {EXONS}, {merged('m', 'ex', 'side, seqid, strand')} SELECT * FROM m",
    "distinct_intervals": f"WITH {EXONS} SELECT DISTINCT side, seqid, strand, start0, end0 FROM ex",
    "training_spans": f"WITH {TSPANS} SELECT * FROM tspans",
    "utr_only_parents": f"""WITH {TRAINING} SELECT {TT} FROM tr GROUP BY {TT}
 HAVING NOT bool_or(kind IN ('exon', 'CDS'))""",
    "transcript_bounds": f"WITH {TPAIRS} SELECT * FROM tbounds",
    "length_caps": f"""WITH {TPAIRS},
caps AS (SELECT 'span' AS pair, max(end0 - start0) AS longest FROM tbounds
 UNION ALL SELECT 'intron', max(end0 - start0) FROM tintrons)
SELECT pair, longest, greatest(2000, longest) AS cap FROM caps""",
    "label_bits": f"""WITH {TPAIRS},
b AS (SELECT seqid, start0 AS pos, CASE WHEN strand = '+' THEN 1 ELSE 128 END AS bit FROM tbounds
 UNION ALL SELECT seqid, end0, CASE WHEN strand = '+' THEN 8 ELSE 16 END FROM tbounds
 UNION ALL SELECT seqid, start0, CASE WHEN strand = '+' THEN 2 ELSE 64 END FROM tintrons
 UNION ALL SELECT seqid, end0, CASE WHEN strand = '+' THEN 4 ELSE 32 END FROM tintrons)
SELECT seqid, pos, CAST(bit_or(bit) AS INTEGER) AS labels FROM b GROUP BY seqid, pos""",
    "chains": f"""WITH {CHAINS} SELECT side, seqid, strand, n_spans, start0, end0, bases FROM (
 SELECT DISTINCT side, seqid, strand, n_spans, start0, end0, bases, chain FROM chains)""",
    "introns": f"WITH {INTRONS} SELECT DISTINCT side, seqid, strand, start0, end0 FROM introns",
    "site_keys": f"""WITH {CHAINS}, {gaps("introns", "spans", TX)}
SELECT DISTINCT * FROM (
 SELECT side, seqid, strand, 'donor-site' AS site, CASE WHEN strand = '+' THEN start0 + 1 ELSE end0 END AS pos FROM introns
 UNION ALL SELECT side, seqid, strand, 'acceptor-site', CASE WHEN strand = '+' THEN end0 ELSE start0 + 1 END FROM introns
 UNION ALL SELECT side, seqid, strand, 'start-site', CASE WHEN strand = '+' THEN start0 + 1 ELSE end0 END FROM chains
 UNION ALL SELECT side, seqid, strand, 'stop-site', CASE WHEN strand = '+' THEN end0 ELSE start0 + 1 END FROM chains)""",
    "bp_overlap": f"WITH {EXONS} {OVERLAP_SELECT.format(source='ex')}",
    "coverage_envelopes": f"WITH {CHAINS}, {merged('m', 'chains', 'side, seqid, strand')} SELECT * FROM m",
    "alternative_loci": f"WITH {ALTERNATIVES} SELECT * FROM altregions",
    "overlap_semi": f"""WITH {CHAINS}, {REGIONS}, {merged('r', 'regions', 'seqid, strand')},
d AS (SELECT DISTINCT side, seqid, strand, n_spans, start0, end0, chain FROM chains)
SELECT side, seqid, strand, n_spans, start0, end0 FROM d SEMI JOIN r ON d.seqid = r.seqid
 AND d.strand = r.strand AND r.start0 < d.end0 AND d.start0 < r.end0""",
    "overlap_anti": f"""WITH {EXONS}, {REGIONS}, {merged('m', 'ex', 'seqid, strand')}
SELECT seqid, strand, start0, end0 FROM regions d ANTI JOIN m ON d.seqid = m.seqid
 AND d.strand = m.strand AND m.start0 < d.end0 AND d.start0 < m.end0""",
    "accuracy_report": report(ALTERNATIVES) + f" SELECT {RATES} FROM full_report",
    "accuracy_tsv": report(ALTERNATIVES)
    + """ SELECT metric, concat_ws(chr(9), metric, coalesce(printf('%.8f', f1), 'NA'),
 coalesce(printf('%.8f', precision), 'NA'), coalesce(printf('%.8f', recall), 'NA'),
 tp, fp, fn, reference, prediction) AS line FROM full_report""",
    "protein_coding_accuracy": report(
        ALTERNATIVES.replace("WHERE kind = 'CDS' OR NOT p)", "WHERE kind = 'CDS')", 1)
    )
    + f" SELECT {RATES} FROM full_report",
    "gene_set_summary": f"""WITH {EXONS}, t AS (SELECT side, tid, seqid, bool_or(kind = 'CDS') AS c FROM ex GROUP BY ALL)
SELECT side, count(*) AS transcripts_scored, count(*) FILTER (c) AS transcripts_with_cds,
 count(DISTINCT seqid) AS unique_seqids FROM t GROUP BY side""",
    "reciprocal_overlap": f"""WITH {SPANS},
l AS (SELECT tid, CAST(coalesce(sum(end0 - start0) FILTER (side = 0), 0) AS BIGINT) AS len0,
 CAST(coalesce(sum(end0 - start0) FILTER (side = 1), 0) AS BIGINT) AS len1 FROM spans GROUP BY tid),
o AS (SELECT a.tid, CAST(sum(greatest(0, least(a.end0, b.end0) - greatest(a.start0, b.start0))) AS BIGINT) AS shared
 FROM spans a JOIN spans b ON a.tid = b.tid AND a.side = 0 AND b.side = 1 GROUP BY a.tid)
SELECT tid, shared, len0, len1, shared >= len0 - len0 // 4 AND shared >= len1 - len1 // 4 AS reciprocal
FROM l JOIN o USING (tid)""",
    "base_counts": f"""WITH {CONTIGS}, b AS (SELECT seqid, unnest(string_split(bases, '')) AS base FROM contigs)
SELECT seqid, CAST(instr('ACGT', base) - 1 AS INTEGER) AS code, count(*) AS n FROM b GROUP BY ALL""",
    "revcomp": f"""WITH {CONTIGS} SELECT seqid, md5(reverse(translate(bases, 'ACGT', 'TGCA'))) AS digest,
 md5(reverse(translate(bases, 'ACGTRYMKBDHVN', 'TGCAYRKMVHDBN'))) AS iupac_digest FROM contigs""",
    "stop_codons": f"""WITH {CONTIGS}, p AS (SELECT seqid, unnest(range(length)) AS i, unnest(string_split(bases, '')) AS b FROM contigs),
k AS (SELECT * FROM (SELECT seqid, i % 3 AS frame, b || lead(b) OVER w || lead(b, 2) OVER w AS codon FROM p
 WINDOW w AS (PARTITION BY seqid ORDER BY i)) WHERE codon IS NOT NULL)
SELECT seqid, CAST(frame AS INTEGER) AS frame, count(*) FILTER (codon IN ('TAA', 'TAG', 'TGA')) AS stops, count(*) AS codons
FROM k GROUP BY ALL""",
    "contig_tiles": f"""WITH {CONTIGS}, t AS (SELECT *, unnest(range((length - 1) // 16384 + 1)) AS tile FROM contigs)
SELECT seqid, tile, tile * 16384 AS origin, CAST(least(98, tile * 16384) AS INTEGER) AS "left",
 CAST(least(16384, length - tile * 16384) AS INTEGER) AS core,
 md5(bases[tile * 16384 - least(98, tile * 16384) + 1 : (tile + 1) * 16384 + 98]) AS digest FROM t""",
    "longest_orf": f"""WITH {CONTIGS}, src AS (SELECT seqid AS id, bases FROM contigs), {orfs('orf', 'src')}
SELECT id AS seqid, start, stop FROM orf""",
    "transcript_orfs": f"""WITH {FORMS} SELECT id AS tid, length(bases) AS spliced_length,
 coalesce(start, 0) AS orf_start, coalesce(stop, 0) AS orf_stop FROM spliced LEFT JOIN torf USING (id)""",
    "cds_phase": f"""WITH {FORMS},
e AS (SELECT tid, s, e, row_number() OVER w AS exon,
  coalesce(sum(e - s) OVER (PARTITION BY tid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM oriented WINDOW w AS (PARTITION BY tid ORDER BY s)),
c AS (SELECT e.*, start, stop, least(greatest(start - before, 0), e - s) AS lo,
  least(greatest(stop - before, 0), e - s) AS hi FROM e JOIN torf ON tid = id),
p AS (SELECT tid, exon, 'five_prime_UTR' AS kind, s AS start0, s + lo AS end0, -1 AS phase FROM c
 UNION ALL SELECT tid, exon, 'CDS', s + lo, s + hi, (3 - greatest(before + lo - start, 0) % 3) % 3 FROM c
 UNION ALL SELECT tid, exon, 'three_prime_UTR', s + hi, e, -1 FROM c)
SELECT tid, CAST(exon AS INTEGER) AS exon, kind, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0,
 CAST(phase AS INTEGER) AS phase FROM p WHERE end0 > start0""",
    "motif_sites": f"""WITH {CONTIGS},
p AS (SELECT seqid, length, i, b || lead(b) OVER (PARTITION BY seqid ORDER BY i) AS pair FROM
 (SELECT seqid, length, unnest(range(length)) AS i, unnest(string_split(bases, '')) AS b
  FROM contigs WHERE length >= 3)),
r(mode, strand, role, pair, shift) AS (VALUES
 ('gtag', '+', 'start', 'GT', 1), ('gtag', '+', 'end', 'AG', 2),
 ('gtag', '-', 'start', 'CT', 1), ('gtag', '-', 'end', 'AC', 2),
 ('aggt', '+', 'start', 'AG', 3), ('aggt', '+', 'end', 'GT', 0),
 ('aggt', '-', 'start', 'AC', 3), ('aggt', '-', 'end', 'CT', 0))
SELECT mode, seqid, strand, role, count(*) AS n, CAST(sum(i + shift) AS BIGINT) AS total, max(i + shift) AS "last"
FROM p JOIN r USING (pair) WHERE role <> 'start' OR i + shift <= length GROUP BY ALL""",
    "gff3_roundtrip": """WITH r AS (SELECT 'c' || ((l_orderkey // 2) % 16) AS seqid,
 CASE WHEN l_returnflag = 'N' THEN 'exon' ELSE 'CDS' END AS kind, l_partkey * 50 AS start0,
 l_partkey * 50 + CAST(l_quantity AS BIGINT) AS end0, l_orderkey AS k FROM lineitem),
t AS (SELECT r.*, unnest(['a b+' || k, 'o' || k]) AS tid FROM r)
SELECT tid, seqid, '+' AS strand, kind, start0, end0, tid AS gid FROM t""",
    "bed_roundtrip": f"WITH {REGIONS} SELECT seqid, start0, end0, strand FROM regions",
}
ORACLES["fasta_roundtrip"] = f"""WITH {CONTIGS},
t AS (SELECT *, unnest(range((length - 1) // 16384 + 1)) AS tile FROM contigs)
SELECT seqid, CAST(dense_rank() OVER (ORDER BY ord) - 1 AS INTEGER) AS ord, tile, length,
 md5(bases[tile * 16384 + 1 : (tile + 1) * 16384]) AS digest FROM t"""


# Energy ----------------------------------------------------------------------


def energy_sql() -> str:
    """CTEs ending in pw(seqid, pos, power): tap sums as shifted window values."""
    from genomeframe.operators.energy import SCALES, morlet_kernel

    reach = max(len(morlet_kernel(s)) // 2 for s in SCALES)
    shifts = range(-reach, reach + 1)
    name = {o: f"{'m' if o < 0 else 'p'}{abs(o)}" for o in shifts}
    shifted = ", ".join(
        f"coalesce(lag({c}, {-o}) OVER w, 0) AS {c}_{name[o]}" for o in shifts for c in "uv"
    )
    sums = []
    for s in SCALES:
        kernel = morlet_kernel(s)
        half = len(kernel) // 2
        taps = [(t - half, k) for t, k in enumerate(kernel)]
        re = " + ".join(f"u_{name[o]} * ({k.real!r}) - v_{name[o]} * ({k.imag!r})" for o, k in taps)
        im = " + ".join(f"u_{name[o]} * ({k.imag!r}) + v_{name[o]} * ({k.real!r})" for o, k in taps)
        sums.append(f"CAST({re} AS FLOAT) AS r{s}, CAST({im} AS FLOAT) AS i{s}")
    total = " + ".join(f"CAST(r{s} * r{s} + i{s} * i{s} AS DOUBLE)" for s in SCALES)
    text = f"""sig AS (SELECT seqid, pos,
  CASE WHEN b IN ('A', 'T') THEN 1 WHEN b IN ('C', 'G') THEN -1 ELSE 0 END / sqrt(2.0) AS u,
  CASE WHEN b IN ('A', 'G') THEN 1 WHEN b IN ('C', 'T') THEN -1 ELSE 0 END / sqrt(2.0) AS v
 FROM (SELECT seqid, unnest(range(length)) AS pos, unnest(string_split(bases, '')) AS b FROM contigs)),
shifted AS (SELECT seqid, pos, {shifted} FROM sig WINDOW w AS (PARTITION BY seqid ORDER BY pos)),
coef AS (SELECT seqid, pos, {', '.join(sums)} FROM shifted),
pw AS MATERIALIZED (SELECT seqid, pos, ({total}) / {len(SCALES)} AS power FROM coef)"""
    return text.replace("np.float64(", "(")


ENERGY = energy_sql()

PROFILE = f"""{PLACED}, {ENERGY},
iv AS (SELECT DISTINCT seqid, strand, start0, end0 FROM placed),
wn AS (SELECT seqid, strand, boundary, centre, count(*) AS copies FROM (
 SELECT seqid, strand, 'start' AS boundary, CASE WHEN strand = '+' THEN start0 ELSE end0 - 1 END AS centre FROM iv
 UNION ALL SELECT seqid, strand, 'end', CASE WHEN strand = '+' THEN end0 - 1 ELSE start0 END FROM iv) GROUP BY ALL),
prof AS (SELECT boundary, CASE WHEN strand = '+' THEN o ELSE -o END AS "offset",
  round(sum(power * copies) / sum(copies), 5) AS mean_power
 FROM (SELECT *, unnest(range(-600, 601)) AS o FROM wn) x JOIN pw ON pw.seqid = x.seqid AND pw.pos = centre + o
 GROUP BY ALL)"""

PEAKS = PROFILE + """,
curve AS (SELECT *, mean_power > lag(mean_power) OVER w AND mean_power >= lead(mean_power) OVER w AS top FROM prof
 WHERE (boundary = 'start' AND "offset" BETWEEN -100 AND -1) OR (boundary = 'end' AND "offset" BETWEEN 1 AND 100)
 WINDOW w AS (PARTITION BY boundary ORDER BY "offset")),
peaks AS (SELECT boundary, "offset" AS peak FROM curve
 QUALIFY row_number() OVER (PARTITION BY boundary ORDER BY coalesce(top, false) DESC, mean_power DESC, "offset") = 1)"""

GENES = PLACED + """,
closure AS (SELECT DISTINCT tid AS node, CASE WHEN c_custkey IS NOT NULL THEN 'g' || c_custkey END AS gene,
  coalesce(o_orderpriority = '5-LOW', false) AS rrna
 FROM placed LEFT JOIN orders ON tid = 't' || o_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
gx AS (SELECT DISTINCT seqid, start0, end0, strand, length, CASE WHEN gene IS NOT NULL THEN tid END AS tid
 FROM placed JOIN closure ON tid = node WHERE kind = 'exon' AND NOT rrna),
tx AS (SELECT * FROM gx WHERE tid IS NOT NULL),
st AS (SELECT tid, min(start0) AS fs, last(end0 ORDER BY start0, end0) AS le, count(*) AS n FROM tx GROUP BY tid),
x AS (SELECT tx.*, fs, le, n,
  CASE WHEN strand = '+' THEN start0 = fs ELSE end0 = le END AS isfirst,
  CASE WHEN strand = '+' THEN end0 = le ELSE start0 = fs END AS islast FROM tx JOIN st USING (tid)),
""" + gaps("gin", "tx", "tid, seqid, strand")

KBOUNDS = GENES + """,
kb0 AS (SELECT a.seqid, a.start0, a.end0, a.strand, a.length, a.tid,
  coalesce(max(b.end0) FILTER (b.end0 <= a.start0), 0) AS below,
  coalesce(min(b.start0) FILTER (b.start0 >= a.end0), a.length) AS above
 FROM x a JOIN x b ON a.tid = b.tid WHERE a.n > 1
 GROUP BY a.seqid, a.start0, a.end0, a.strand, a.length, a.tid),
kb1 AS (SELECT seqid, start0, end0, strand, length, max(below) AS below, min(above) AS above FROM kb0 GROUP BY ALL),
kb AS (SELECT seqid, start0, end0, strand,
  CASE WHEN strand = '+' THEN below ELSE length - above END AS bound_low,
  CASE WHEN strand = '+' THEN above ELSE length - below END AS bound_high FROM kb1)"""

KMERS = KBOUNDS + PEAKS[len(PLACED):] + """,
ke AS (SELECT DISTINCT seqid, strand, start0, end0, length FROM gx),
kw AS (SELECT ke.*, coalesce(bound_low, 0) AS bl, coalesce(bound_high, length) AS bh,
  CASE WHEN strand = '+' THEN start0 ELSE length - end0 END AS f,
  CASE WHEN strand = '+' THEN end0 ELSE length - start0 END AS l
 FROM ke LEFT JOIN kb USING (seqid, start0, end0, strand)),
ks AS (SELECT *, 'start' AS boundary, f AS anchor, bl AS low, f AS high FROM kw
 UNION ALL SELECT *, 'end', l - 1, l, bh FROM kw),
kp AS (SELECT ks.*, peak, anchor + peak AS site FROM ks JOIN peaks USING (boundary)),
kc AS (SELECT kp.*, CASE WHEN strand = '+' THEN site ELSE kp.length - 1 - site END AS centre,
  site - 10 >= greatest(low, 0) AND site + 11 <= least(high, kp.length) AS inside FROM kp),
kt AS (SELECT kc.*, CASE WHEN inside THEN CASE WHEN strand = '+' THEN bases[centre - 9 : centre + 11]
  ELSE reverse(translate(bases[centre - 9 : centre + 11], 'ACGT', 'TGCA')) END END AS raw
 FROM kc JOIN contigs USING (seqid)),
km AS (SELECT *, CASE WHEN regexp_full_match(raw, '[ACGT]{21}') THEN raw END AS kmer FROM kt)"""

SAMPLES = f"""{CONTIGS}, src AS (SELECT seqid AS id, bases FROM contigs), {orfs('orf', 'src')},
sd AS (SELECT CASE WHEN t <= 10000 THEN 1 ELSE CAST(pow(2, ceil(log2(t / 10000.0))) AS BIGINT) END AS stride
 FROM (SELECT 2 * sum(length) AS t FROM contigs)),
pos0 AS (SELECT seqid, ord, length, unnest(range(length + 1)) AS pos FROM contigs),
bits(strand, type, bit) AS (VALUES ('+', 0, 0), ('+', 1, 1), ('+', 2, 2), ('+', 3, 3),
 ('-', 0, 4), ('-', 1, 5), ('-', 2, 6), ('-', 3, 7)),
good AS (SELECT id AS seqid, '+' AS strand, start AS pos, 0 AS type FROM orf
 UNION ALL SELECT id, '+', stop, 3 FROM orf
 UNION ALL SELECT id, '+', start + (stop - start) // 3, 1 FROM orf
 UNION ALL SELECT id, '+', start + (stop - start) // 3 * 2, 2 FROM orf),
neg AS (SELECT seqid, strand, pos, type FROM pos0, bits, sd
 WHERE ('0x' || substr(md5('0:' || ord || ':' || CASE WHEN strand = '+' THEN pos ELSE length - pos END || ':' || bit), 1, 15))::BIGINT
  % stride = 0),
sam AS (SELECT seqid, strand, pos, type, 1 AS target, 1.0::DOUBLE AS weight FROM good
 UNION ALL SELECT seqid, strand, pos, type, 0, CAST(stride AS DOUBLE) FROM neg ANTI JOIN good USING (seqid, strand, pos, type), sd)"""

POINTS = """pts AS (SELECT CAST(user_id AS VARCHAR) AS seqid, '+' AS strand, CAST(floor(epoch(ts)) AS BIGINT) AS pos,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS kind,
  max(ln(value / 50)) AS logit FROM events WHERE value >= 50 AND event_type <> 'error' GROUP BY ALL),
cand AS (SELECT a.seqid, a.strand, a.pos AS start0, b.pos AS end0,
  a.logit + b.logit + (1.0 - (b.pos - a.pos) / 200000.0::DOUBLE) AS score
 FROM pts a JOIN pts b ON a.seqid = b.seqid AND a.kind = 0 AND b.kind = 3 AND b.pos > a.pos AND b.pos - a.pos <= 200000
 WHERE 1.0 - (b.pos - a.pos) / 200000.0::DOUBLE >= 0)"""

CONTROL_DRAW = "('0x' || substr(md5('42:{what}:' || seqid || ':' || start0 || ':' || end0 || ':' || strand || ':' || replicate), 1, 15))::BIGINT"

ORACLES |= {
    "energy_per_contig": f"""WITH {CONTIGS}, {ENERGY} SELECT seqid, count(*) AS n,
 round(avg(power), 5) AS mean_power, round(max(power), 5) AS max_power FROM pw GROUP BY seqid""",
    "energy_quantile": f"WITH {CONTIGS}, {ENERGY} SELECT round(quantile_cont(power, 0.995), 5) AS quantile FROM pw",
    "profile_rows": f"""WITH {PLACED}, iv AS (SELECT DISTINCT seqid, strand, start0, end0 FROM placed),
k AS (SELECT *, row_number() OVER (ORDER BY end0 - start0, seqid, start0, end0, strand) - 1 AS rank FROM iv),
t AS (SELECT count(*) AS n, least(1500, count(*)) AS bins FROM iv),
e AS (SELECT r AS row, CAST(floor(r * (n / bins)) AS BIGINT) AS edge FROM t, range(1500) x(r) WHERE r < bins)
SELECT seqid, strand, start0, end0, rank, row FROM k ASOF JOIN e ON k.rank >= e.edge""",
    "boundary_profile": f'WITH {PROFILE} SELECT boundary, "offset", mean_power FROM prof',
    "profile_peaks": f"WITH {PEAKS} SELECT boundary, peak FROM peaks",
    "feature_ancestors": f"WITH {GENES} SELECT node, gene, rrna FROM closure",
    "exon_sets": f"""WITH {GENES} SELECT DISTINCT * FROM (
 SELECT 'exons' AS "set", seqid, start0, end0, strand FROM gx
 UNION ALL SELECT 'introns', seqid, start0, end0, strand FROM gin
 UNION ALL SELECT CASE WHEN n > 1 THEN 'multi-exons' ELSE 'single-exons' END, seqid, start0, end0, strand FROM x
 UNION ALL SELECT 'first-exons', seqid, start0, end0, strand FROM x WHERE isfirst
 UNION ALL SELECT 'last-exons', seqid, start0, end0, strand FROM x WHERE islast
 UNION ALL SELECT 'first-last-start', seqid, start0, end0, strand FROM x WHERE isfirst AND n > 1
 UNION ALL SELECT 'first-last-end', seqid, start0, end0, strand FROM x WHERE islast AND n > 1)""",
    "kmer_bounds": f"WITH {KBOUNDS} SELECT * FROM kb",
    "exclusion_masks": f"""WITH {GENES}, gi AS (SELECT seqid, start0, end0 FROM gx UNION ALL SELECT seqid, start0, end0 FROM gin),
rp AS (SELECT seqid, place % length AS start0, least(place % length + 40, length) AS end0 FROM
  (SELECT CAST(o_custkey % (SELECT count(*) FROM documents) AS VARCHAR) AS id, o_orderkey * 31 AS place FROM orders) JOIN contigs ON id = seqid),
gr AS (SELECT seqid, start0, end0 FROM gx UNION ALL SELECT * FROM rp), gir AS (SELECT * FROM gi UNION ALL SELECT * FROM rp),
{merged('m1', 'gx', 'seqid')}, {merged('m2', 'gi', 'seqid')}, {merged('m3', 'gr', 'seqid')}, {merged('m4', 'gir', 'seqid')}
SELECT *, 'exons' AS mask FROM m1 UNION ALL SELECT *, 'exons+introns' FROM m2
UNION ALL SELECT *, 'exons+repeats' FROM m3 UNION ALL SELECT *, 'exons+introns+repeats' FROM m4""",
    "splice_site_positions": f"""WITH {GENES}, p AS (
 SELECT seqid, unnest([fs, fs + 1, le - 2, le - 1]) AS pos FROM (SELECT DISTINCT seqid, tid, fs, le FROM x)
 UNION ALL SELECT seqid, pos FROM (SELECT seqid, start0, end0, unnest([start0, start0 + 1, end0 - 2, end0 - 1]) AS pos FROM gin)
  WHERE pos >= start0 AND pos < end0)
SELECT DISTINCT p.seqid, pos FROM p JOIN contigs c ON p.seqid = c.seqid WHERE pos >= 0 AND pos < c.length""",
    "kmers": f"WITH {KMERS} SELECT seqid, strand, start0, end0, boundary, coalesce(kmer, '') AS kmer FROM km",
    "kmer_information": f"""WITH {KMERS},
b AS (SELECT boundary, unnest(range(21)) AS "column", unnest(string_split(kmer, '')) AS base FROM km WHERE kmer IS NOT NULL),
c AS (SELECT boundary, "column", base, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT *, n / sum(n) OVER w AS p, log2(sum(n) OVER w) - sum(n * log2(n)) OVER w / sum(n) OVER w AS entropy FROM c
 WINDOW w AS (PARTITION BY boundary, "column"))
SELECT boundary, "column", base, n, round(p * least(greatest(2.0 - entropy, 0.0), 2.0), 6) AS bits FROM h""",
    "kmer_fasta": f"""WITH {KMERS}, h AS (SELECT boundary, kmer, peak, seqid || ':' || (start0 + 1) || '-' || end0 || ':' || strand || ':'
 || CASE boundary WHEN 'start' THEN 'U' ELSE 'D' END || ':' || (centre + 1) || ':dist='
 || CASE WHEN peak >= 0 THEN '+' ELSE '' END || peak || 'bp' AS header FROM km WHERE kmer IS NOT NULL)
SELECT boundary, '>' || header || chr(10) || kmer AS fasta, boundary || chr(9) || header || chr(9) || peak AS distance FROM h""",
    "matched_controls": f"""WITH {PLACED}, iv AS (SELECT DISTINCT seqid, strand, start0, end0 FROM placed),
{merged('mk', 'iv', 'seqid')},
cl AS (SELECT seqid, CAST(length AS BIGINT) AS length FROM contigs),
edge AS (SELECT mk.seqid, mk.start0, least(mk.end0, length) AS end0 FROM mk JOIN cl ON mk.seqid = cl.seqid WHERE mk.start0 < length
 UNION ALL SELECT seqid, unnest([0, length]) AS start0, start0 AS end0 FROM cl),
gap AS (SELECT seqid, end0 AS start0, following - end0 AS room FROM (SELECT *, lead(start0) OVER
  (PARTITION BY seqid ORDER BY start0, end0) AS following FROM edge) WHERE following > end0),
size AS (SELECT DISTINCT end0 - start0 AS size FROM iv WHERE end0 > start0),
fit AS (SELECT size, gap.*, CAST(sum(room - size + 1) OVER (PARTITION BY size ORDER BY room DESC, seqid, start0
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM size JOIN gap ON room >= size),
all_ AS (SELECT size, max(upto) AS places FROM fit GROUP BY size),
item AS (SELECT iv.*, size, {CONTROL_DRAW.format(what='place')} % places AS nth,
  CASE WHEN {CONTROL_DRAW.format(what='strand')} % 2 = 0 THEN '+' ELSE '-' END AS cstrand
  FROM (SELECT *, 1 AS replicate FROM iv) iv JOIN all_ ON end0 - start0 = size),
won AS (SELECT item.seqid, item.start0, item.end0, item.strand, item.cstrand, fit.seqid AS cid,
  fit.start0 + nth - (upto - (room - item.size + 1)) AS cs0, item.size FROM item ASOF JOIN fit ON item.size = fit.size AND item.nth < fit.upto)
SELECT iv.seqid AS item_seqid, iv.start0 AS item_start0, iv.end0 AS item_end0, iv.strand AS item_strand,
 1 AS replicate, cid AS seqid, cs0 AS start0, cs0 + size AS end0, cstrand AS strand,
 CASE WHEN iv.end0 <= iv.start0 THEN 'no length left' WHEN cid IS NULL THEN 'no free place' END AS reason
FROM iv LEFT JOIN won ON iv.seqid = won.seqid AND iv.start0 = won.start0 AND iv.end0 = won.end0 AND iv.strand = won.strand""",
    "site_samples": f"WITH {SAMPLES} SELECT * FROM sam",
    "class_weights": f"""WITH {SAMPLES} SELECT type, sum(weight) AS population, CAST(sum(target) AS BIGINT) AS positives,
 count(*) AS samples, round(CASE WHEN sum(target) > 0 THEN (sum(weight) - sum(target)) / sum(target) END, 6) AS positive_weight
FROM sam GROUP BY type""",
    "pair_samples": f"""WITH {CONTIGS}, src AS (SELECT seqid AS id, bases FROM contigs), {orfs('orf', 'src')},
mv AS (SELECT id, start, stop, start AS s, stop AS e FROM orf
 UNION SELECT id, start, stop, start + o, stop FROM (SELECT *, unnest(range(-64, 65)) AS o FROM orf)
 UNION SELECT id, start, stop, start, stop + o FROM (SELECT *, unnest(range(-64, 65)) AS o FROM orf))
SELECT id AS seqid, '+' AS strand, count(*) AS n, CAST(count(*) FILTER (s = start AND e = stop) AS BIGINT) AS positives,
 CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM mv JOIN contigs c ON id = c.seqid
WHERE s >= 0 AND e <= length AND e - s BETWEEN 1 AND 10000 GROUP BY id""",
    "encoded_sites": f"""WITH {SAMPLES} SELECT s.seqid, strand, pos, type, 645 AS size,
 CAST(length(regexp_replace(bases[greatest(pos - 64 - (strand = '-')::INT, 0) + 1 : pos + 65 - (strand = '-')::INT],
  '[^ACGT]', '', 'g')) AS BIGINT) AS known FROM sam s JOIN contigs c ON s.seqid = c.seqid""",
    "span_candidates": f"WITH {POINTS} SELECT seqid, strand, start0, end0, round(score, 6) AS score FROM cand",
    "best_chain": f"""WITH RECURSIVE {POINTS},
walk AS (SELECT seqid, strand, end0, score FROM cand WHERE score > 0
 UNION ALL SELECT c.seqid, c.strand, c.end0, w.score + c.score FROM walk w JOIN cand c
  ON c.seqid = w.seqid AND c.strand = w.strand AND c.start0 >= w.end0 WHERE c.score > 0)
SELECT seqid, strand, round(max(score), 6) AS score FROM walk GROUP BY seqid, strand""",
    "bedgraph_rows": f"""WITH {POINTS},
p AS (SELECT *, pos - CASE WHEN kind = 3 THEN 1 ELSE 0 END AS start0 FROM pts)
SELECT CASE kind WHEN 0 THEN 'GS' WHEN 1 THEN 'IS' WHEN 2 THEN 'IE' ELSE 'GE' END AS kind, strand, seqid, start0,
 start0 + 1 AS end0, format('{{:.6g}}', 1 / (1 + exp(-logit))) AS value FROM p""",
    "gene_numbers": f"""WITH {PLACED},
s AS (SELECT tid, seqid, strand, min(start0) AS a, max(end0) AS b, max(length) AS length FROM placed GROUP BY tid, seqid, strand),
g AS (SELECT seqid, strand, length, a, max(b) AS b FROM s GROUP BY ALL)
SELECT g.seqid, strand, CASE WHEN strand = '+' THEN a ELSE g.length - b END AS span_start,
 CASE WHEN strand = '+' THEN b ELSE g.length - a END AS span_end,
 row_number() OVER (ORDER BY ord, CASE WHEN strand = '+' THEN 0 ELSE 1 END, a) AS gene
FROM g JOIN contigs c ON g.seqid = c.seqid""",
}

ORACLES |= {
    "gff3_training": """SELECT 'c' || ((l_orderkey // 2) % 16) AS seqid, '+' AS strand,
 unnest(['a%20b+' || l_orderkey, 'o' || l_orderkey]) AS tid,
 CASE WHEN l_returnflag = 'N' THEN 'exon' ELSE 'CDS' END AS kind, l_partkey * 50 AS start0,
 l_partkey * 50 + CAST(l_quantity AS BIGINT) AS end0 FROM lineitem""",
    "gff3_features": """SELECT 'x' AS id, 'a%20b+' || l_orderkey || '|o' || l_orderkey AS parents,
 CASE WHEN l_returnflag = 'N' THEN 'exon' ELSE 'CDS' END AS kind, 'c' || ((l_orderkey // 2) % 16) AS seqid,
 '+' AS strand, l_partkey * 50 AS start0, l_partkey * 50 + CAST(l_quantity AS BIGINT) AS end0,
 false AS rrna, false AS repeat FROM lineitem""",
}

DENSE = """dp AS (SELECT CAST(l_orderkey % 16 AS VARCHAR) AS seqid, CASE WHEN (l_orderkey // 16) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  l_partkey * 10 + l_linenumber AS pos, CAST((l_orderkey + l_linenumber) % 4 AS INTEGER) AS kind,
  max((l_quantity + l_discount * 100) / 20 + l_extendedprice / 1000000) AS logit,
  max(((l_suppkey % 13) - 8) / 4.0::DOUBLE) AS part FROM lineitem GROUP BY ALL)"""
DENSE_SPANS = f"""{DENSE},
dc AS (SELECT a.seqid, a.strand, a.pos AS start0, b.pos AS end0, a.part + b.part + (1.0::DOUBLE - (b.pos - a.pos) / 400.0::DOUBLE) AS pair,
  a.logit + b.logit AS sites FROM dp a JOIN dp b ON a.seqid = b.seqid AND a.strand = b.strand AND a.kind = 0 AND b.kind = 3
  AND b.pos > a.pos AND b.pos - a.pos <= 400 WHERE pair >= 0)"""
DENSE_INTRONS = f"""{DENSE},
ds AS (SELECT DISTINCT seqid, strand, pos // 500 * 500 AS span_start, pos // 500 * 500 + 250 AS span_end FROM dp),
din AS (SELECT ds.*, pos, kind, logit, part FROM dp JOIN ds ON dp.seqid = ds.seqid AND dp.strand = ds.strand
  AND pos > span_start AND pos < span_end AND kind IN (1, 2)),
di AS (SELECT a.seqid, a.strand, a.span_start, a.span_end, a.pos AS start0, b.pos AS end0,
  a.logit + b.logit + (a.part + b.part + (1.0::DOUBLE - (b.pos - a.pos) / 250.0::DOUBLE) * -0.25) AS score
  FROM din a JOIN din b ON a.seqid = b.seqid AND a.strand = b.strand AND a.span_start = b.span_start
  AND a.kind = 1 AND b.kind = 2 AND b.pos - a.pos BETWEEN 20 AND 250 WHERE score > 0)"""

ORACLES |= {
    "dense_span_candidates": f"""WITH {DENSE_SPANS} SELECT seqid, strand, count(*) AS n, CAST(sum(start0) AS BIGINT) AS starts,
 CAST(sum(end0) AS BIGINT) AS ends, round(sum(sites + pair), 4) AS score FROM dc GROUP BY seqid, strand""",
    # best[k + 1] is the best total of the first k candidates by end; a candidate adds to the best of those that end before it
    "dense_best_chain": f"""WITH RECURSIVE {DENSE_SPANS},
o AS (SELECT *, sites + pair AS score, row_number() OVER (PARTITION BY seqid, strand ORDER BY end0, start0) AS i,
  count(*) OVER (PARTITION BY seqid, strand ORDER BY end0) AS upto FROM dc WHERE sites + pair > 0),
e AS (SELECT seqid, strand, end0, max(upto) AS upto FROM o GROUP BY ALL),
q AS (SELECT o.seqid, o.strand, i, score, coalesce(e.upto, 0) AS before FROM o ASOF LEFT JOIN e
  ON o.seqid = e.seqid AND o.strand = e.strand AND o.start0 >= e.end0),
g AS (SELECT seqid, strand, list(score ORDER BY i) AS scores, list(before ORDER BY i) AS befores FROM q GROUP BY ALL),
walk AS (SELECT seqid, strand, scores, befores, 0 AS i, [0.0::DOUBLE] AS best FROM g
 UNION ALL SELECT seqid, strand, scores, befores, i + 1,
  list_append(best, greatest(best[i + 1], best[befores[i + 1] + 1] + scores[i + 1])) FROM walk WHERE i < len(scores))
SELECT seqid, strand, round(best[i + 1], 4) AS score FROM walk WHERE i = len(scores)""",
    "intron_candidates": f"""WITH {DENSE_INTRONS}
SELECT seqid, strand, span_start, span_end, start0, end0, round(score, 9) AS score FROM di""",
    "top_chains": f"""WITH RECURSIVE {DENSE_INTRONS},
n AS (SELECT *, row_number() OVER (PARTITION BY seqid, strand, span_start ORDER BY start0, end0) - 1 AS i FROM di),
walk AS (SELECT seqid, strand, span_start, span_end, end0, i, score, 1 AS introns FROM n
 UNION ALL SELECT n.seqid, n.strand, n.span_start, n.span_end, n.end0, n.i, w.score + n.score, introns + 1 FROM walk w JOIN n
  ON n.seqid = w.seqid AND n.strand = w.strand AND n.span_start = w.span_start AND n.start0 > w.end0),
kept AS (SELECT *, row_number() OVER (PARTITION BY seqid, strand, span_start, i ORDER BY score DESC) AS k FROM walk QUALIFY k <= 8),
near AS (SELECT *, max(score) OVER (PARTITION BY seqid, strand, span_start) AS top FROM kept),
form AS (SELECT *, row_number() OVER (PARTITION BY seqid, strand, span_start ORDER BY score DESC, i, k) - 1 AS rank FROM near
 WHERE score >= top - 8)
SELECT ds.seqid, ds.strand, ds.span_start, ds.span_end, coalesce(rank, 0) AS rank, round(coalesce(score, 0), 9) AS score,
 CAST(coalesce(introns, 0) + 1 AS BIGINT) AS n_exons FROM ds LEFT JOIN form ON ds.seqid = form.seqid AND ds.strand = form.strand
 AND ds.span_start = form.span_start""",
}

ORACLES["bedgraph_roundtrip"] = f"""WITH {DENSE}, p AS (SELECT seqid, strand, kind, logit,
 pos - CASE WHEN kind = 3 THEN 1 ELSE 0 END AS x FROM dp),
g AS (SELECT *, CASE WHEN strand = '+' THEN x ELSE 3000000 - 1 - x END AS start0 FROM p)
SELECT CASE kind WHEN 0 THEN 'GS' WHEN 1 THEN 'IS' WHEN 2 THEN 'IE' ELSE 'GE' END AS kind,
 CASE WHEN strand = '+' THEN 'plus' ELSE 'minus' END AS track, seqid, start0, start0 + 1 AS end0,
 format('{{:.6g}}', 1 / (1 + exp(-logit))) AS value, true AS sorted FROM g WHERE start0 >= 0 AND start0 < 3000000"""

# every base's share of the bins that it touches
ORACLES["region_energy"] = f"""WITH {CONTIGS}, {ENERGY},
r AS (SELECT pw.seqid AS region, power, least(1600, length) AS n, length / least(1600, length)::DOUBLE AS width,
  CASE WHEN ord % 2 = 0 THEN pos ELSE length - 1 - pos END AS x FROM pw JOIN contigs c ON pw.seqid = c.seqid),
b AS (SELECT *, unnest(range(CAST(floor(x / width) AS BIGINT), least(CAST(floor((x + 1) / width) AS BIGINT), n - 1) + 1)) AS bin FROM r),
s AS (SELECT region, bin, sum(power * greatest(least(x + 1, (bin + 1) * width) - greatest(x, bin * width), 0) / width) AS mean_power
  FROM b GROUP BY region, bin)
SELECT region, bin, round(mean_power, 5) AS mean_power, round(ln(1 + mean_power), 5) AS log_power FROM s"""

ORACLES["dense_pair_samples"] = f"""WITH {DENSE},
ds AS (SELECT DISTINCT seqid, strand, pos // 500 * 500 AS s, pos // 500 * 500 + 250 AS e FROM dp),
k AS (SELECT *, row_number() OVER (PARTITION BY seqid, strand ORDER BY s, e) AS i FROM ds),
c AS (SELECT a.seqid, a.strand, a.s, b.e FROM k a JOIN k b ON a.seqid = b.seqid AND a.strand = b.strand AND abs(a.i - b.i) <= 4
 UNION SELECT seqid, strand, s + o, e FROM (SELECT *, unnest(range(-64, 65)) AS o FROM ds)
 UNION SELECT seqid, strand, s, e + o FROM (SELECT *, unnest(range(-64, 65)) AS o FROM ds))
SELECT c.seqid, c.strand, count(*) AS n, count(ds.s) AS positives, CAST(sum(c.s) AS BIGINT) AS starts, CAST(sum(c.e) AS BIGINT) AS ends
FROM c LEFT JOIN ds ON c.seqid = ds.seqid AND c.strand = ds.strand AND c.s = ds.s AND c.e = ds.e
WHERE c.s >= 0 AND c.e <= 3000000 AND c.e - c.s BETWEEN 20 AND 2000 GROUP BY c.seqid, c.strand"""

LANDMARKS = f"""{PLACED},
lx AS (SELECT DISTINCT tid, seqid, strand, CASE WHEN strand = '+' THEN start0 ELSE -end0 END AS s,
  CASE WHEN strand = '+' THEN end0 ELSE -start0 END AS e FROM placed WHERE kind = 'exon'),
lk AS (SELECT *, row_number() OVER (PARTITION BY tid, seqid, strand ORDER BY s, e) AS up,
  row_number() OVER (PARTITION BY tid, seqid, strand ORDER BY s DESC, e DESC) AS down FROM lx),
lc AS (SELECT tid, seqid, strand, CASE WHEN strand = '+' THEN start0 ELSE -end0 END AS s,
  CASE WHEN strand = '+' THEN end0 ELSE -start0 END AS e FROM placed SEMI JOIN lx USING (tid, seqid, strand) WHERE kind = 'CDS'),
ld AS (SELECT *, row_number() OVER (PARTITION BY tid, seqid, strand ORDER BY s, e) AS up,
  row_number() OVER (PARTITION BY tid, seqid, strand ORDER BY s DESC, e DESC) AS down FROM lc),
lm AS (SELECT tid, seqid, strand, 'Start' AS landmark, s AS place FROM ld WHERE up = 1
 UNION ALL SELECT tid, seqid, strand, 'Stop', e - 1 FROM ld WHERE down = 1
 UNION ALL SELECT a.tid, a.seqid, a.strand, 'IS', a.e FROM lk a JOIN lk b ON a.tid = b.tid AND a.seqid = b.seqid AND a.strand = b.strand
  AND a.up = 1 AND b.up = 2 WHERE a.e < b.s
 UNION ALL SELECT a.tid, a.seqid, a.strand, 'IE', b.s - 1 FROM lk a JOIN lk b ON a.tid = b.tid AND a.seqid = b.seqid AND a.strand = b.strand
  AND a.down = 2 AND b.down = 1 WHERE a.e <= b.s - 1)"""

ORACLES["landmark_profile"] = f"""WITH {LANDMARKS}, {ENERGY},
pwl AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS r FROM pw WINDOW w AS (PARTITION BY seqid ORDER BY pos)),
mk AS (SELECT seqid, strand, landmark, CASE WHEN strand = '+' THEN place ELSE -place - 1 END AS pos FROM lm),
at_ AS (SELECT *, unnest(range(-15, 16)) AS d FROM mk),
hit AS (SELECT landmark, CASE WHEN strand = '+' THEN d ELSE -d END AS "offset", power,
  CASE WHEN l IS NULL AND r IS NULL THEN 0 ELSE (coalesce(r, power) - coalesce(l, power)) / ((l IS NOT NULL)::INT + (r IS NOT NULL)::INT) END
   * CASE WHEN strand = '+' THEN 1 ELSE -1 END AS slope
  FROM at_ JOIN pwl ON pwl.seqid = at_.seqid AND pwl.pos = at_.pos + d)
SELECT landmark, "offset", round(avg(power), 5) AS mean_power, round(avg(slope), 5) AS mean_slope, count(*) AS n FROM hit GROUP BY ALL"""
