"""Errors of the engine, all under EngineError."""


class EngineError(Exception):
    pass


class MutationError(EngineError):
    """A value that the engine holds was changed from outside."""


class UntrackedReadError(EngineError):
    """A plan or a function reads a source that the query doesn't declare."""


class UnsupportedValueError(EngineError, TypeError):
    """A value without a canonical form."""


class AdapterContractError(EngineError):
    """A value adapter that doesn't give back what it took."""


class CycleError(EngineError):
    """A query that needs its own answer."""


class ReentrantDatabaseError(EngineError):
    """A call that would change the engine while it is evaluating."""


class CompositionError(EngineError):
    """An administrative call inside a query."""


class InputKeyError(EngineError, ValueError):
    pass


class CheckpointError(EngineError):
    pass


class CheckpointVersionError(CheckpointError):
    pass


class CheckpointManifestError(CheckpointError):
    pass


class CheckpointIntegrityError(CheckpointError):
    pass


class CheckpointModeError(CheckpointError):
    pass


class ActionError(EngineError):
    pass


class ActionPathError(ActionError):
    pass


class ActionManifestError(ActionError):
    pass


class ActionLockTimeoutError(ActionError, TimeoutError):
    pass


class ArtifactStoreError(EngineError):
    pass


class ArtifactStoreKeyError(ArtifactStoreError, KeyError):
    pass


class ArtifactStoreLockError(ArtifactStoreError, TimeoutError):
    pass


class SchemaGenerationError(EngineError):
    """A schema with errors, of which nothing is generated."""
