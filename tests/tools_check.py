"""Re-export of the comparison helpers used by tools/check.py."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import norm, table_hash  # noqa: E402,F401
