"""What to extract: declared nodes, run settings, the prompt, and the result schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

# Default settings and their limits.
DEFAULT_CHUNK_SIZE = 50000
DEFAULT_TEMPERATURE = 0.0
DEFAULT_TIMEOUT = 30
DEFAULT_MAX_FAILURES = 2
MAX_FAILURES_LIMIT = 5
# Formats a node may declare; they shape the typed view only.
FORMATS = ("text", "number", "boolean")
# Columns every result row has before the node columns.
RESULT_KEYS = ("request_id", "file", "chunknumber")
RUN_KEYS = ("run_tag", "run_id", "wave")


@dataclass(frozen=True)
class NodeSpec:
    """One field to ask for; stored only when it names a ``db_column``."""

    name: str
    description: str
    format: str | None = None
    db_column: str | None = None
    required: bool | None = None

    def prompt_line(self) -> str:
        marker = {True: " (required)", False: " (optional)", None: ""}[self.required]
        suffix = f" ({self.format})" if self.format else ""
        return f"- {self.name}{marker}: {self.description}{suffix}"


@dataclass(frozen=True)
class ExtractionSpec:
    """The declared nodes plus the settings of a run, checked on construction."""

    name: str
    nodes: tuple[NodeSpec, ...]
    prompt_template: str
    model: str = "rules"
    chunk_size: int = DEFAULT_CHUNK_SIZE
    temperature: float = DEFAULT_TEMPERATURE
    timeout: int = DEFAULT_TIMEOUT
    max_failures: int = DEFAULT_MAX_FAILURES

    def __post_init__(self) -> None:
        def require(holds: bool, message: str) -> None:
            if not holds:
                raise ValueError(message)

        def is_int(value: object) -> bool:
            return isinstance(value, int) and not isinstance(value, bool)

        require(bool(self.name), "name must not be empty")
        require(is_int(self.chunk_size) and self.chunk_size > 0, "chunk_size must be an integer > 0")
        require(is_int(self.timeout) and self.timeout > 0, "timeout must be an integer > 0")
        require(
            isinstance(self.temperature, (int, float)) and 0 <= self.temperature <= 1,
            "temperature must be between 0 and 1",
        )
        require(
            is_int(self.max_failures) and 1 <= self.max_failures <= MAX_FAILURES_LIMIT,
            f"max_failures must be between 1 and {MAX_FAILURES_LIMIT}",
        )
        require(isinstance(self.model, str) and bool(self.model), "model must not be empty")
        names = [node.name for node in self.nodes]
        require(len(set(names)) == len(names), "node names must be unique")
        columns = [c.lower() for c in self.db_columns.values()]
        require(len(set(columns)) == len(columns), "db_columns must be unique")
        taken = {key.lower() for key in RESULT_KEYS + RUN_KEYS}
        require(not taken & set(columns), f"db_columns must differ from {sorted(taken)}")

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any]) -> "ExtractionSpec":
        """Build a spec from an already parsed configuration mapping.

        Sections ``name``, ``defaults``, ``nodes`` and ``prompt_template`` are mandatory,
        and every node needs a description; ``required`` must be literally true or false.
        """
        for section in ("name", "defaults", "nodes", "prompt_template"):
            if section not in config:
                raise ValueError(f"The configuration has no section '{section}'.")
        nodes = []
        for name, node in config["nodes"].items():
            if not isinstance(node, Mapping) or "description" not in node:
                raise ValueError(f"The node '{name}' has no description.")
            required = node.get("required")
            if "required" in node and not isinstance(required, bool):
                raise ValueError(f"'required' of node '{name}' must be true or false.")
            nodes.append(
                NodeSpec(
                    name, node["description"], node.get("format"), node.get("db_column"), required
                )
            )
        settings = config["defaults"]
        known = ("model", "chunk_size", "temperature", "timeout", "max_failures")
        return cls(
            name=config["name"],
            nodes=tuple(nodes),
            prompt_template=config["prompt_template"],
            **{key: settings[key] for key in known if key in settings},
        )

    @property
    def prompt(self) -> str:
        lines = "\n".join(node.prompt_line() for node in self.nodes)
        return self.prompt_template.format(node_descriptions=lines)

    @property
    def required_nodes(self) -> list[str]:
        return [node.name for node in self.nodes if node.required]

    @property
    def db_columns(self) -> dict[str, str]:
        """Node name to stored column, for the nodes that are stored."""
        return {node.name: node.db_column for node in self.nodes if node.db_column}

    @property
    def formats(self) -> dict[str, str]:
        """Stored column to declared format."""
        return {n.db_column: n.format or "text" for n in self.nodes if n.db_column}

    @property
    def result_schema(self) -> T.StructType:
        """Stored results: fixed keys, one string per stored node, then the run keys."""
        schema = T.StructType(
            [
                T.StructField("request_id", T.StringType(), False),
                T.StructField("file", T.StringType(), False),
                T.StructField("chunknumber", T.IntegerType(), False),
            ]
        )
        for column in self.db_columns.values():
            schema = schema.add(column, T.StringType())
        return schema.add("run_tag", "string").add("run_id", "string").add("wave", T.IntegerType())


CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType(), False),
        T.StructField("chunknumber", T.IntegerType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("chunknumber", T.IntegerType(), False),
        T.StructField("attempt", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("model", T.StringType(), False),
        T.StructField("raw_response", T.StringType()),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("outcome", T.StringType(), False),
        T.StructField("error_message", T.StringType()),
        T.StructField("extracted", T.MapType(T.StringType(), T.StringType())),
        T.StructField("run_tag", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("wave", T.IntegerType()),
    ]
)
