"""All registered queries; importing this package fills the registry."""

from quillmark.catalog import annotated, assembly, learned, lexical, sources_of_code, stores, texts  # noqa: F401
from quillmark.catalog.registry import QUERIES, SQL  # noqa: F401
