"""Typed errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(EngineError):
    """A contract or engine file is unreadable or invalid; names the corpus and file."""

    def __init__(self, message: str, corpus: str = "", path: str = ""):
        self.corpus, self.path = corpus, path
        super().__init__(f"{corpus or 'engine'} ({path}): {message}" if corpus or path else message)


class AdapterError(EngineError):
    """A source cannot be read: unknown adapter, missing location, malformed file."""


class TransformError(EngineError):
    """Unknown transform, or a transform without its parameter."""


class DedupeError(EngineError):
    """Invalid dedupe key, order or policy."""


class PipelineError(EngineError):
    """An ingest run was aborted or asked for an unknown source."""


class EmbeddingError(EngineError):
    """An embedder has no library or key."""


class RerankError(EngineError):
    """Reranking was enabled; there is none."""


class ViewConfigError(EngineError):
    """Invalid view declaration."""


class FilterError(EngineError):
    """Invalid view filter."""


class MaterializeError(EngineError):
    """Input that a view cannot be built on."""


class StaleViewError(EngineError):
    """A view was never materialised or is older than its freshness."""


class QueryParamsError(EngineError):
    """Unknown field or operation, or a malformed request."""


class ModeError(EngineError):
    """A retrieval mode that the contract does not declare."""


class StaleCursorError(EngineError):
    """A cursor that is corrupt, or of another query or index version."""


class RecordStoreRequired(EngineError):
    """Filters or sorting were asked for without a record store."""
