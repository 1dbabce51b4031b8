"""quire: a Spark-native index over trees of Markdown concepts.

Every operator is a function ``f(DataFrame, ...) -> DataFrame`` so that it
composes with the rest of a Spark job; time (``now``) is always an argument.

The most used entry points, by task:

* index: ``read_markdown`` -> ``run_index`` (or ``build_concepts`` for a
  one-off table); ``start_ingest`` for a stream of file records
* search: ``search`` (one query) and ``search_batch`` (a query table), on the stored index that ``run_index`` and ``start_ingest``
  keep under ``index_base`` (``open_index``) or on postings made for the call
* browse: ``list_concepts``, ``changes_since``, ``stats_by_type``, ``tag_counts``
* graph: ``references``, ``referenced_by``, ``dependencies``, ``dependents``,
  ``resolve_dependencies``, ``dependency_tree``, ``concept_record``
* maintenance: ``deindex_slugs``, ``deindex_prefixes``, ``slug_conflicts``
"""

from quire.operators.browse import changes_since, list_concepts, stats_by_type, tag_counts  # noqa: F401
from quire.operators.graph import (  # noqa: F401
    concept_record,
    dependencies,
    dependency_tree,
    dependents,
    references,
    referenced_by,
    resolve_dependencies,
)
from quire.operators.hybrid import search, search_batch  # noqa: F401
from quire.operators.maintain import deindex_prefixes, deindex_slugs, slug_conflicts  # noqa: F401
from quire.operators.parse import build_concepts, parse_files  # noqa: F401
from quire.operators.search_index import open_index  # noqa: F401
from quire.plans.index_run import run_index  # noqa: F401
from quire.schema import CONCEPT_SCHEMA, LIST_DEFAULTS, SEARCH_DEFAULTS  # noqa: F401
from quire.sources.markdown import read_markdown  # noqa: F401
from quire.streaming.ingest import start_ingest  # noqa: F401

__version__ = "0.1.0"
