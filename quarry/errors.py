"""Errors of the engine, by the stage that finds them."""


class EngineError(Exception):
    """Base of all errors below."""


class ParseError(EngineError):
    """The statement isn't one that the engine knows."""


class BindError(EngineError):
    """Names, arity or types of a statement don't fit the catalog."""


class CatalogError(EngineError):
    """An object is missing or already there."""


class ConstraintError(EngineError):
    """Rows violate a constraint; nothing of their statement was written."""


# What exactly was wrong, each below its stage.

class DatabaseAlreadyExists(CatalogError):
    pass


class DatabaseNotFound(CatalogError):
    pass


class SchemaAlreadyExists(CatalogError):
    pass


class SchemaNotFound(CatalogError):
    pass


class TableAlreadyExists(CatalogError):
    pass


class TableNotFound(CatalogError):
    pass


class ObjectNotFound(CatalogError):
    """A constraint or sequence that isn't there."""


class InvalidConnectionLimit(BindError):
    pass


class DuplicateColumn(BindError):
    pass


class ColumnNotFound(BindError):
    pass


class MultiplePrimaryKeys(BindError):
    pass


class ArityMismatch(BindError):
    """A row has more or fewer values than there are columns."""


class TypeMismatch(BindError):
    """A value is of another family than its column."""


class NotNullViolation(ConstraintError):
    pass


class UniqueViolation(ConstraintError):
    pass


class CheckViolation(ConstraintError):
    pass


class ForeignKeyViolation(ConstraintError):
    pass
