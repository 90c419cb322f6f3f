"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pairloom.llm import base_queries, hmm, leaks, mixing, projections, quality, repeats, resampling, simhash, spelling, sstable, toxicity, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_tokens": sstable.op3_tokens,
        "op4_warc": warc.op4_warc,
        "op5_suffix": repeats.op5_suffix,
        "op6_substring": repeats.op6_substring,
        "op7_mixing": mixing.op7_mixing,
        "op8_leaks": leaks.op8_leaks,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_hmm": hmm.op10_hmm,
        "op11_resampling": resampling.op11_resampling,
        "op12_projections": projections.op12_projections,
        "op13_spelling": spelling.op13_spelling,
        "quality_base": base_queries.quality_base,
        "unigram_base": base_queries.unigram_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.OP4_SQL, "op5_suffix": repeats.OP5_SQL, "op6_substring": repeats.OP6_SQL, "op7_mixing": mixing.OP7_SQL,
        "op11_resampling": resampling.OP11_SQL, "op12_projections": projections.OP12_SQL, "op13_spelling": spelling.OP13_SQL,
        "quality_base": base_queries.QUALITY_SQL, "unigram_base": base_queries.UNIGRAM_SQL,
    }
