import pytest

pytest.importorskip("lanewise.llm")
