"""Policies, errors and record schemas. Limits are guards: going over one raises, results are never cut short."""

from __future__ import annotations

from dataclasses import asdict, dataclass


class EngineError(Exception):
    """Base of all errors of the engine."""


class ScanError(EngineError):
    """A tree is invalid or too large to scan."""


class ScanRaceError(ScanError):
    """A tree changed while it was scanned."""


class LexicalError(EngineError):
    """A lexical index is corrupt, or a limit was exceeded."""


class LexicalNotReady(LexicalError):
    """No index exists for the repository."""


class LexicalStale(LexicalError):
    """The index belongs to another snapshot or policy."""


class LexicalQueryError(LexicalError):
    """A query is empty, too long or too broad."""


class StructuralError(EngineError):
    """A structural index is corrupt, or a limit was exceeded."""


class StructuralNotReady(StructuralError):
    """No index exists for the repository."""


class StructuralStale(StructuralError):
    """The index belongs to another snapshot or policy."""


class StructuralQueryError(StructuralError):
    """A query has an invalid limit or matches too many rows."""


class BudgetError(EngineError):
    """A ledger operation is refused."""


class BudgetExceeded(BudgetError):
    """A reservation does not fit into what its period has left."""


class BudgetLocked(BudgetError):
    """A period has a breach and takes no more reservations."""


class BudgetConflict(BudgetError):
    """A key, or its period's limit, is bound to something else."""


class BudgetInvariant(BudgetError):
    """The ledger says what must not be."""


class CallError(EngineError):
    """A paid call is refused or did not end."""


class CallReplayBlocked(CallError):
    """A call of this key has been dispatched before."""


class CallUncertain(CallError):
    """A call was dispatched and nobody knows how it ended."""


class RuntimeUnavailable(EngineError):
    """A model's runtime does not answer."""


#: The error of an outcome that a caller cannot go on with; all others are results.
OUTCOME_ERRORS = {"exceeded": BudgetExceeded, "locked": BudgetLocked, "policy": BudgetConflict, "conflict": BudgetConflict, "contract": BudgetConflict, "quote": BudgetConflict, "invariant": BudgetInvariant, "unknown": BudgetError, "replay": CallReplayBlocked, "uncertain": CallUncertain, "degraded": RuntimeUnavailable, "unavailable": RuntimeUnavailable}


def demanded(outcome: str) -> str:
    """The outcome of a single event of the ledger, the call journal or a runtime's health; one that a caller cannot go on with raises its error."""
    error = OUTCOME_ERRORS.get(outcome)
    if error:
        raise error(outcome)
    return outcome


class ContractError(EngineError, ValueError):
    """A value breaks a record's contract."""


# The defaults of the three policies.


@dataclass(frozen=True)
class ScanPolicy:
    excluded_names: tuple[str, ...] = (".git", ".hg", ".svn", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "node_modules", "venv")
    max_entries: int = 200_000
    sample_bytes: int = 8192
    max_ignore_bytes: int = 4 << 20


@dataclass(frozen=True)
class LexicalPolicy:
    max_file_bytes: int = 8 << 20
    max_chunk_chars: int = 6000
    chunk_lines: int = 120
    overlap_lines: int = 12
    max_chunks: int = 5000
    max_query_chars: int = 1000
    max_query_terms: int = 32
    max_candidates: int = 2000
    default_limit: int = 12
    max_results: int = 100

    def __post_init__(self):
        for name, value in asdict(self).items():
            least = 0 if name == "overlap_lines" else 1
            if isinstance(value, bool) or not isinstance(value, int) or value < least:
                raise ContractError(f"{name} must be a whole number of {least} or more")
        if self.overlap_lines >= self.chunk_lines:
            raise ContractError("overlap_lines must be less than chunk_lines")


@dataclass(frozen=True)
class StructuralPolicy:
    max_file_bytes: int = 4 << 20
    max_nodes: int = 250_000
    max_symbols: int = 50_000
    max_imports: int = 50_000
    default_limit: int = 100
    max_results: int = 2000


#: Record schemas as DDL.
ENTRY = "path string, kind string, size_bytes long, sha256 string, executable boolean, content_kind string, language string"
CHUNK = "path string, chunk_index int, start_line int, end_line int, content string"
SYMBOL = (
    "symbol_id string, path string, file_sha256 string, kind string, name string, qualified_name string, parent_symbol_id string, parent_qualified_name string,"
    "start_line int, start_col int, end_line int, end_col int, signature string, decorators array<string>"
)
IMPORT = "import_id string, path string, file_sha256 string, kind string, module string, name string, alias string, level int, scope_symbol_id string, scope_qualified_name string, line int, col int, ordinal int"

#: Closed sets of the records.
ENTRY_KINDS, CONTENT_KINDS = ("file", "symlink", "special"), ("empty", "text", "binary", "not_applicable")
SYMBOL_KINDS = ("class", "function", "async_function", "method", "async_method", "variable", "type_alias")
RESERVATION_STATUSES, CALL_STATUSES = ("active", "settled", "cancelled", "breached"), ("prepared", "dispatching", "completed", "not_sent", "uncertain")


def checked_limit(limit: int | None, default: int, most: int, error: type[EngineError]) -> int:
    """1 to most; True is not a number."""
    if limit is None:
        return default
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise error(f"limit must be between 1 and {most}")
    return limit
