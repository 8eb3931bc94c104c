"""The operators' queries over the corpus tables, and their SQL."""

from .chunks import op7
from .ctw import op1
from .html_crf import op5
from .line_dedup import OP10_SQL, op10
from .mixing import op3
from .near_dedup import op9
from .packing import op8
from .quality import op4
from .syncmers import op6
from .warc import OP2_SQL
from .warc import op2 as _op2


def op2(spark, sf_dir):
    return _op2(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_ctw_scores": op1,
    "op2_arc_to_warc": op2,
    "op3_curriculum_mix": op3,
    "op4_weak_supervision": op4,
    "op5_crf_main_text": op5,
    "op6_closed_syncmers": op6,
    "op7_chunk_repeats": op7,
    "op8_binary_packing": op8,
    "op9_setsketch_groups": op9,
    "op10_line_dedup": op10,
}
SQL = {"op2_arc_to_warc": OP2_SQL, "op10_line_dedup": OP10_SQL}
