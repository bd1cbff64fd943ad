"""The relations' columns and the engine's numbers."""

from __future__ import annotations

from dataclasses import dataclass

CHUNK = "content string, file_path string, start_line int, end_line int, kind string, name string, language string"
CHUNK_COLUMNS = ("content", "file_path", "start_line", "end_line", "kind", "name", "language")
NODE = "id string, kind string, label string, file_path string, chunk_id string, language string"
EDGE = "source_id string, target_id string, kind string, confidence double"


@dataclass(frozen=True)
class Bm25:
    """Scorer: ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (k1 * (1 - b + b * dl / avgdl) + tf)."""

    k1: float = 1.5
    b: float = 0.75


#: Weights of the fields in the combined BM25 search, in the order that breaks ties.
FIELD_WEIGHTS = {"content": 1.0, "name": 6.0, "path": 3.0}
#: Reciprocal-rank fusion, recall, graph expansion, coherence, saturation.
RRF_K, RECALL = 60, 100
SEEDS, IMPORT_BOOST, DEFINITION_BOOST, REFERENCE_BOOST = 20, 0.22, 0.35, 0.16
COHERENCE, SATURATION, TINY = 0.15, 0.65, 1e-12
#: Confidences of the graph's edges.
CONTAINS, DEFINES, IMPORTS_MODULE, IMPORTS_FILE, REFERENCES = 1.0, 1.0, 0.95, 1.0, 0.55
#: Limits of scans and chunks.
MOST_FILE_BYTES, MOST_IDENTIFIERS = 1_000_000, 200
#: Suffixes of source files.
SUFFIXES = (
    ".c", ".cc", ".cpp", ".cs", ".cxx", ".dart", ".ex", ".exs", ".go", ".h", ".hh", ".hpp", ".hxx", ".java", ".js", ".cjs", ".jsx", ".kt", ".kts", ".lua", ".m", ".mjs", ".mm", ".php", ".py", ".pyi",
    ".rb", ".rs", ".scala", ".sc", ".swift", ".sh", ".bash", ".zsh", ".ts", ".tsx", ".zig",
)
#: Directories that a scan leaves out.
IGNORED_DIRS = (".git", ".hg", ".svn", "__pycache__", ".venv", "venv", ".tox", ".pytest_cache", ".ruff_cache", ".cache", "node_modules", "build", "dist", "case")
