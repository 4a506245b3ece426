import pytest

from syllabica.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=8)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
