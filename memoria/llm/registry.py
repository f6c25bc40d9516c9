"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from memoria.llm import quality, ranked, secrets, urls
from memoria.llm.bpe import op10_bpe
from memoria.llm.counts import op13_token_counts
from memoria.llm.decontaminate import op6_decontaminate
from memoria.llm.langid import op7_langid
from memoria.llm.pii import op2_pii
from memoria.llm.quality import op5_quality
from memoria.llm.ranked import op12_ranked_search
from memoria.llm.runs import op11_runs
from memoria.llm.secrets import op4_secrets
from memoria.llm.simhash import op9_simhash
from memoria.llm.suffixes import op1_suffixes
from memoria.llm.toxicity import op8_toxicity
from memoria.llm.urls import op3_urls
from memoria.sources.shipping import ship_package


def shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_suffixes": op1_suffixes,
        "op2_pii": op2_pii,
        "op3_urls": op3_urls,
        "op4_secrets": op4_secrets,
        "op5_quality": op5_quality,
        "op6_decontaminate": op6_decontaminate,
        "op7_langid": op7_langid,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_bpe": op10_bpe,
        "op11_runs": op11_runs,
        "op12_ranked_search": op12_ranked_search,
        "op13_token_counts": op13_token_counts,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": urls.ORACLE, "op4_secrets": secrets.ORACLE, "op5_quality": quality.ORACLE, "op12_ranked_search": ranked.ORACLE}
