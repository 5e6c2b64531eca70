"""Registered queries against their oracle SQL on the smallest driver tables."""

import pytest

from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "interval_merge",
    "training_spans",
    "label_bits",
    "chains",
    "site_keys",
    "accuracy_report",
    "overlap_semi",
    "overlap_anti",
    "cds_phase",
    "motif_sites",
    "energy_per_contig",
    "exon_sets",
    "site_samples",
    "best_chain",
    "bedgraph_rows",
    "gene_numbers",
    "fasta_roundtrip",
    "gff3_roundtrip",
    "introns",
    "bp_overlap",
    "dense_best_chain",
    "intron_candidates",
    "top_chains",
    "matched_controls",
    "exclusion_masks",
    "longest_orf",
    "bedgraph_roundtrip",
    "dense_pair_samples",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    same, note = compare(spark, con, name, FOLDER)
    assert same, note
