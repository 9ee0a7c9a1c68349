"""The subpackage's queries and the SQL that states their results."""

from __future__ import annotations

from . import automata, neighbours, oracles
from .automata import op10_automaton_substring_dedup
from .fertility import op7_tokeniser_fertility
from .mixing import op5_subset_sum_mixing
from .neighbours import op9_rotated_code_neighbours
from .packing import op1_best_fit_packing
from .privacy import op4_information_theoretic_pii
from .quality import op2_fourier_quality_classifier
from .resharding import op6_min_cost_flow_resharding
from .simhash import op3_simhash_near_dedup
from .suffix_array import op8_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_fourier_quality_classifier,
        op3_simhash_near_dedup,
        op4_information_theoretic_pii,
        op5_subset_sum_mixing,
        op6_min_cost_flow_resharding,
        op7_tokeniser_fertility,
        op8_suffix_array_dedup,
        op9_rotated_code_neighbours,
        op10_automaton_substring_dedup,
    )
}
#: The others learn, tokenise with a vocabulary file, or choose among equals.
ORACLES: dict[str, str] = {
    "op3_simhash_near_dedup": oracles.NEAR_DEDUP,
    "op8_suffix_array_dedup": oracles.REPEATS,
    "op9_rotated_code_neighbours": neighbours.ORACLE,
    "op10_automaton_substring_dedup": automata.ORACLE,
}
