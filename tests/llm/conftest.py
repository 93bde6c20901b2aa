import pytest


@pytest.fixture(autouse=True)
def _installed():
    pytest.importorskip("quillstone.llm.queries")
