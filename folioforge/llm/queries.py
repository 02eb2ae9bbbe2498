"""The subpackage's queries and their DuckDB twins, for the registry."""

from folioforge.llm import decontaminate, elkan, page_twins, phrases, secret_scan
from folioforge.llm.bpe import op2_bpe
from folioforge.llm.cws import op7_fingerprints
from folioforge.llm.decontaminate import op1_decontaminate
from folioforge.llm.elkan import op11_clusters
from folioforge.llm.extract import op5_extract
from folioforge.llm.langid import op12_language
from folioforge.llm.licenses import op10_licenses
from folioforge.llm.phrases import op13_phrases
from folioforge.llm.quality import op8_quality
from folioforge.llm.secret_scan import op6_secrets
from folioforge.llm.simhash import op4_simhash
from folioforge.llm.toxicity import op3_toxicity
from folioforge.llm.warc import op9_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_extract": op5_extract,
    "op6_secrets": op6_secrets,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_clusters": op11_clusters,
    "op12_language": op12_language,
    "op13_phrases": op13_phrases,
}

ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op5_extract": page_twins.EXTRACT, "op6_secrets": secret_scan.ORACLE, "op9_warc": page_twins.WARC, "op11_clusters": elkan.ORACLE, "op13_phrases": phrases.ORACLE}
