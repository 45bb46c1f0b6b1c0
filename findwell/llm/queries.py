"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from findwell.llm.fingerprints import op8_fingerprints
from findwell.llm.language import op6_language
from findwell.llm.mixing import op5_mix_sources
from findwell.llm.near_dedup import op2_near_dedup
from findwell.llm.neighbours import op9_neighbours
from findwell.llm.packing import op1_pack
from findwell.llm.quotations import op10_quotations
from findwell.llm.substrings import op3_substrings
from findwell.llm.suffixes import op4_suffixes
from findwell.llm.token_files import op7_token_files

QUERIES = {
    "op1_pack": op1_pack,
    "op2_near_dedup": op2_near_dedup,
    "op3_substrings": op3_substrings,
    "op4_suffixes": op4_suffixes,
    "op5_mix_sources": op5_mix_sources,
    "op6_language": op6_language,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_neighbours": op9_neighbours,
    "op10_quotations": op10_quotations,
}

#: None of these can be written as SQL; tests hold them against brute force instead.
ORACLES: dict[str, str] = {}
