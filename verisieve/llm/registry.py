"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verisieve.llm import capjoin, chat, dartminhash, decontam, domainmix, licenses, mixing_lm, packing, partcodes, pii, quality, suffixes, turnrepair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_cap_join": capjoin.op2_cap_join,
        "op3_suffix_repeats": suffixes.op3_suffix_repeats,
        "op4_context_mixing": mixing_lm.op4_context_mixing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_pii_surrogates": pii.op6_pii_surrogates,
        "op7_dart_minhash": dartminhash.op7_dart_minhash,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_quality_ranking": quality.op9_quality_ranking,
        "op10_domain_mixing": domainmix.op10_domain_mixing,
        "op11_part_codes": partcodes.op11_part_codes,
        "op12_turn_repair": turnrepair.op12_turn_repair,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_cap_join": capjoin.OP2_SQL, "op8_chat_formatting": chat.OP8_SQL, "op11_part_codes": partcodes.OP11_SQL, "op12_turn_repair": turnrepair.OP12_SQL}
