"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_phrase_collocations
from .conversation_repair import op11_conversation_repair
from .decontaminate import op10_decontamination
from .html_text import op8_html_extraction
from .jaccard_join import op3_ngram_jaccard_join
from .language import op9_language_id
from .packing import op2_packing
from .pii import op1_pii
from .quality_model import op4_quality_classifier
from .quality_rules import OP6_SQL, op6_quality_rules
from .substring_dedup import op7_substring_dedup
from .toxicity import op5_toxicity
from .warc import op13_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_packing,
        op3_ngram_jaccard_join,
        op4_quality_classifier,
        op5_toxicity,
        op6_quality_rules,
        op7_substring_dedup,
        op8_html_extraction,
        op9_language_id,
        op10_decontamination,
        op11_conversation_repair,
        op12_phrase_collocations,
        op13_warc,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op12_phrase_collocations": OP12_SQL}
