import ast
import os
from pathlib import Path

import pytest

from planaudit.plans import extended, inventory, queries, stored

SF = "/root/testdata/sf0.001"
PLANS = Path(queries.__file__).parent


@pytest.mark.parametrize("path", sorted(PLANS.glob("*.py")), ids=lambda p: p.stem)
def test_no_name_is_set_twice(path):
    names = []
    for node in ast.parse(path.read_text()).body:
        names += [t.id for t in getattr(node, "targets", []) if isinstance(t, ast.Name)]
        names += [node.name] if isinstance(node, ast.FunctionDef) else []
    assert sorted(names) == sorted(set(names))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_every_query_can_be_planned(spark):
    found = {}
    for module in (queries, inventory, extended, stored):
        assert not set(found) & set(module.queries())
        found |= module.queries()
    for name, build in found.items():
        assert build(spark, SF).columns, name
