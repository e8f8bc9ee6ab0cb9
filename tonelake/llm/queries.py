"""The queries of the subpackage, and DuckDB SQL where it can express them."""

from tonelake.llm.fingerprints import op1_fingerprints
from tonelake.llm.langid import op6_language_id
from tonelake.llm.mixing import op10_mixing
from tonelake.llm.media import op9_media_columns
from tonelake.llm.neardup import op3_minhash_neardup
from tonelake.llm.packing import op2_best_fit_packing
from tonelake.llm.pii import op13_pii
from tonelake.llm.passages import op5_substring_dedup
from tonelake.llm.tokenfiles import op8_token_files
from tonelake.llm.whitening import op12_embedding_whitening
from tonelake.llm import resampling, urlrules, warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_url_filters": urlrules.op7_url_filters,
    "op8_token_files": op8_token_files,
    "op9_media_columns": op9_media_columns,
    "op10_mixing": op10_mixing,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": warc.ORACLE, "op7_url_filters": urlrules.ORACLE, "op11_importance_resampling": resampling.ORACLE}
