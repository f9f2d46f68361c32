from __future__ import annotations

import os
from pathlib import Path

# Workers import functions that these tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent), os.environ.get("PYTHONPATH", "")])
