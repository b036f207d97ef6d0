"""Queries of the llm operators and their SQL, by name."""

from functools import wraps

from sparkloom.llm import collocations, htmltext, langid, licenses, linedup, media, mixing, neardup, pii, quality, runs, spm, suffix
from sparkloom.llm.common import small_batches



def _in_small_batches(query):
    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_mixing": mixing.op2_mixing,
    "op3_media": media.op3_media,
    "op4_quality": quality.op4_quality,
    "op5_spm": spm.op5_spm,
    "op6_neardup": neardup.op6_neardup,
    "op7_pii": pii.op7_pii,
    "op8_suffix": suffix.op8_suffix,
    "op9_licenses": licenses.op9_licenses,
    "op10_html": htmltext.op10_html,
    "op11_linedup": linedup.op11_linedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_runs": runs.op13_runs,
}
QUERIES = {name: _in_small_batches(query) for name, query in QUERIES.items()}
ORACLES = {**quality.ORACLE, **linedup.ORACLE, **collocations.ORACLE, **runs.ORACLE}
