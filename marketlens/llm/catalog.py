"""The corpus operators as queries over a folder of test tables."""

from __future__ import annotations

from marketlens.llm.chat import op2_chat_format
from marketlens.llm.decontaminate import op4_decontamination
from marketlens.llm.langid import op9_language_id
from marketlens.llm.mixing import op6_source_mix
from marketlens.llm.neighbours import op7_hilbert_neighbours
from marketlens.llm.periodic import op11_periodic_runs
from marketlens.llm.personal import op12_personal_data
from marketlens.llm.sharding import op3_histogram_sharding
from marketlens.llm.simhash import op8_simhash
from marketlens.llm.suffix_dedup import op1_suffix_dedup
from marketlens.llm.toxicity import op5_toxicity
from marketlens.llm.variants import op13_spelling_variants
from marketlens.llm.warc import op10_warc

QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_dedup,
        op2_chat_format,
        op3_histogram_sharding,
        op4_decontamination,
        op5_toxicity,
        op6_source_mix,
        op7_hilbert_neighbours,
        op8_simhash,
        op9_language_id,
        op10_warc,
        op11_periodic_runs,
        op12_personal_data,
        op13_spelling_variants,
    )
}
