"""All registered queries of the engine's own operators."""

from . import archive_queries, context_queries, dataset_queries, evaluation_queries, gallery_queries, layout_queries, page_queries, search_queries, stream_queries  # noqa: F401
from .catalogue import ORACLE_SQL, QUERIES  # noqa: F401
