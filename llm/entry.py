"""Queries of the operators, for __spark_entry__."""

from __future__ import annotations

from functools import wraps

from .chunks import op9_chunk_dedup
from .common import ship
from .decontaminate import op1_decontamination
from .hpylm import op4_pitman_yor
from .lattice import op2_e8_lattice
from .lines import op7_fuzzy_lines
from .mixing import op5_mixing
from .oracles import E8_LATTICE, SUFFIX_DEDUP
from .order_minhash import op3_order_minhash
from .suffixes import op6_suffix_dedup
from .tokens import op10_token_ids
from .toxicity import op8_toxicity


def shipped(f):
    @wraps(f)
    def run(spark, *args):
        ship(spark)
        return f(spark, *args)

    return run


QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_decontamination,
        op2_e8_lattice,
        op3_order_minhash,
        op4_pitman_yor,
        op5_mixing,
        op6_suffix_dedup,
        op7_fuzzy_lines,
        op8_toxicity,
        op9_chunk_dedup,
        op10_token_ids,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_e8_lattice": E8_LATTICE, "op6_suffix_dedup": SUFFIX_DEDUP}
