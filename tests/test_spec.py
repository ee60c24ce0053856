from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gleanframe.operators.completion import prompt_lines
from gleanframe.plans.sample import SPEC
from gleanframe.spec import ExtractionSpec, NodeSpec

CONFIG = {
    "name": "demo",
    "defaults": {"chunk_size": 10, "temperature": 0, "timeout": 5, "max_failures": 1, "model": "m"},
    "nodes": {
        "notes": {"description": "Notes", "format": "text", "required": False},
        "name": {"description": "Name", "db_column": "title", "required": True},
        "quote": {"description": "A quote.\n", "format": "text", "db_column": "quote"},
    },
    "prompt_template": "Start\n{node_descriptions}\nEnd",
}


def test_prompt_and_columns():
    spec = ExtractionSpec.from_mapping(CONFIG)
    assert spec.prompt == (
        "Start\n- notes (optional): Notes (text)\n- name (required): Name\n"
        "- quote: A quote.\n (text)\nEnd"
    )
    assert spec.required_nodes == ["name"]
    assert spec.db_columns == {"name": "title", "quote": "quote"}
    assert spec.result_schema.fieldNames() == [
        "request_id", "file", "chunknumber", "title", "quote", "run_tag", "run_id", "wave",
    ]


def test_table_of_nodes_gives_the_same_lines(spark):
    rows = [("p", i, n.name, n.description, n.format, n.required) for i, n in enumerate(SPEC.nodes)]
    nodes = spark.createDataFrame(
        rows, "prompt_name string, position int, name string, description string, format string, required boolean"
    )
    prompt = prompt_lines(nodes.repartition(5), "prompt_name").select(F.col("prompt")).first()[0]
    assert prompt == "\n".join(node.prompt_line() for node in SPEC.nodes)


@pytest.mark.parametrize("section", ["name", "defaults", "nodes", "prompt_template"])
def test_missing_sections(section):
    with pytest.raises(ValueError, match=section):
        ExtractionSpec.from_mapping({k: v for k, v in CONFIG.items() if k != section})


@pytest.mark.parametrize(
    "change",
    [
        {"chunk_size": 0}, {"chunk_size": 1.5}, {"chunk_size": True}, {"timeout": 0},
        {"temperature": 1.1}, {"temperature": -0.1}, {"max_failures": 0}, {"max_failures": 6},
        {"model": ""}, {"name": ""},
        {"nodes": (NodeSpec("a", "x"), NodeSpec("a", "y"))},
        {"nodes": (NodeSpec("a", "x", db_column="c"), NodeSpec("b", "y", db_column="C"))},
        {"nodes": (NodeSpec("a", "x", db_column="file"),)},
    ],
)
def test_limits(change):
    with pytest.raises(ValueError):
        replace(SPEC, **change)


@pytest.mark.parametrize("node", [{}, {"description": "x", "required": "yes"}, "text"])
def test_bad_nodes(node):
    with pytest.raises(ValueError):
        ExtractionSpec.from_mapping({**CONFIG, "nodes": {"n": node}})
