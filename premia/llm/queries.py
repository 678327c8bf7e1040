"""Registered queries of this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from premia.llm import (
    collocations,
    decontaminate,
    embedding_dedup,
    jaccard_join,
    langid,
    license_scan,
    packing,
    phrase_automata,
    prefix_trie,
    quality,
    suffix_dedup,
    toxicity,
    warc,
)


def registry() -> dict:
    return {
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
        "op1_quality": (quality.op1_quality, None),
        "op6_license_scan": (license_scan.op6_license_scan, None),
        "op9_embedding_dedup": (embedding_dedup.op9_embedding_dedup, embedding_dedup.ORACLE_SQL),
        "op7_toxicity": (toxicity.op7_toxicity, None),
        "op4_packing": (packing.op4_packing, None),
        "op5_warc": (warc.op5_warc, warc.ORACLE_SQL),
        "op8_decontamination": (decontaminate.op8_decontamination, None),
        "op2_suffix_dedup": (suffix_dedup.op2_suffix_dedup, suffix_dedup.ORACLE_SQL),
        "op3_jaccard_join": (jaccard_join.op3_jaccard_join, jaccard_join.ORACLE_SQL),
        "op11_phrase_automata": (phrase_automata.op11_phrase_automata, phrase_automata.ORACLE_SQL),
        "op12_collocations": (collocations.op12_collocations, collocations.ORACLE_SQL),
        "op13_prefix_trie": (prefix_trie.op13_prefix_trie, prefix_trie.ORACLE_SQL),
        "op10_language_id": (langid.op10_language_id, None),
    }
