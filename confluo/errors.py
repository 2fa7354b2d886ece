"""Typed errors (the reference wrapped everything as HTTP 500)."""


class ConfluoError(Exception):
    pass


class NoTablesError(ConfluoError):
    pass


class MissingColumnsError(ConfluoError):
    def __init__(self, file: str, missing: list[str]):
        self.file, self.missing = file, list(missing)
        super().__init__(f"missing columns in {file}: {', '.join(missing)}")


class FileNotFound(ConfluoError):
    pass


class AmbiguousFileError(ConfluoError):
    pass


class BrokenRecordError(ConfluoError):
    pass


class InvalidRowsError(ConfluoError):
    pass


class InlineTableError(ConfluoError):
    pass


class HeaderCollisionError(ConfluoError):
    pass
