import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import awkward, none  # noqa: E402, F401
