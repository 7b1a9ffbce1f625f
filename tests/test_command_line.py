"""Argument handling of the command line."""


def test_arguments():
    from vitagraph.__main__ import arguments, main
    from vitagraph.plans.registry import QUERIES

    assert arguments(QUERIES["path"], ["a", "b", "max_hops=3"]) == {"from": "a", "to": "b", "max_hops": "3"}
    assert arguments(QUERIES["path"], ["to=b", "a"]) == {"from": "a", "to": "b"}
    assert main(["nothing"]) == 2
    schema = QUERIES["search"].input_schema()
    assert schema["required"] == ["q"] and schema["properties"]["k"] == {"type": "integer"}
