"""Exceptions by family; ``kind`` names the case."""


class RivuletError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class DatasetError(RivuletError):
    """A dataset that can't be opened or breaks its own declarations."""


class ResolutionError(RivuletError):
    """An outlet or option that can't be resolved."""


class TraversalError(RivuletError):
    """A terminal or upstream unit that the graph doesn't have."""


class ExportError(RivuletError):
    """Rows that must not be exported as they are."""
