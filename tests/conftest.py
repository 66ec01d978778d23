import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from skyledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("skyledger-tests", cores=8, partitions=4)
    session.sparkContext.addPyFile(_zip())
    yield session
    session.stop()


def _zip() -> str:
    """The package as a zip for the Python workers, as --py-files ships it on a cluster."""
    import shutil
    import tempfile

    return shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="skyledger-zip-")) / "skyledger"), "zip", ROOT, "skyledger")
