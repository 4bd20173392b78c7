"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from flowlake.llm import centroid_clusters, embedding_dedup, license, line_dedup, merkle, ngram_join, substring_dedup, topk
from flowlake.llm.bpe import op1_bpe
from flowlake.llm.centroid_clusters import op11_centroid_clusters
from flowlake.llm.embedding_dedup import op3_embedding_dedup
from flowlake.llm.license import op6_license
from flowlake.llm.line_dedup import op9_line_dedup
from flowlake.llm.lm_score import op4_lm_score
from flowlake.llm.merkle import op13_merkle
from flowlake.llm.ngram_join import op10_ngram_join
from flowlake.llm.packing import op2_packing
from flowlake.llm.quality import op7_quality
from flowlake.llm.substring_dedup import op8_substring_dedup
from flowlake.llm.token_files import op12_token_files
from flowlake.llm.topk import op5_topk

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_packing, op3_embedding_dedup, op4_lm_score, op5_topk, op6_license, op7_quality, op8_substring_dedup, op9_line_dedup, op10_ngram_join,
        op11_centroid_clusters, op12_token_files, op13_merkle,
    )
}
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": embedding_dedup.ORACLE, "op5_topk": topk.ORACLE, "op6_license": license.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op10_ngram_join": ngram_join.ORACLE,
    "op11_centroid_clusters": centroid_clusters.ORACLE, "op13_merkle": merkle.ORACLE,
}
