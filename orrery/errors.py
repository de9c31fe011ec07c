"""Errors of the vector engine, with the texts that callers rely on."""


class VectorEngineError(ValueError):
    """Base of all of them; a ValueError, so that one except clause is enough."""


class DimensionMismatch(VectorEngineError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")
        self.expected, self.got = expected, got


class EmptyVector(VectorEngineError):
    def __init__(self):
        super().__init__("empty vector")


class NotFound(VectorEngineError):
    def __init__(self, id: int):
        super().__init__(f"vector not found: {id}")
        self.id = id


class DuplicateId(VectorEngineError):
    def __init__(self, id: int):
        super().__init__(f"duplicate id: {id}")
        self.id = id


class InvalidK(VectorEngineError):
    def __init__(self):
        super().__init__("k must be > 0")


class IndexFull(VectorEngineError):
    def __init__(self):
        super().__init__("index is full")


class InvalidParameter(VectorEngineError):
    def __init__(self, message: str):
        super().__init__(f"invalid parameter: {message}")


class EngineIOError(VectorEngineError):
    def __init__(self, message: str):
        super().__init__(f"I/O error: {message}")
