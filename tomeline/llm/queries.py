"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroid_clustering
from .chat_rotation import OP8_SQL, op8_chat_rotation
from .crf_langid import op2_crf_langid
from .decontamination import op4_decontamination
from .graph_ann import op7_graph_ann
from .html_extract import op1_html_extract
from .jaccard_join import op5_jaccard_join
from .mixing import op9_source_mixing
from .periodic_runs import op13_periodic_runs
from .rlz_dedup import op3_rlz_dedup
from .secret_scan import op10_secret_scan
from .suffix_dedup import op11_suffix_dedup
from .token_counts import op6_token_counts

_ALL = (
    op1_html_extract, op2_crf_langid, op3_rlz_dedup, op4_decontamination, op5_jaccard_join, op6_token_counts, op7_graph_ann, op8_chat_rotation, op9_source_mixing, op10_secret_scan,
    op11_suffix_dedup, op12_centroid_clustering, op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op8_chat_rotation": OP8_SQL, "op12_centroid_clustering": OP12_SQL}
