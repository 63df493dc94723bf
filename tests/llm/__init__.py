"""A package, as its files and those of tests may have the same names; its tests import each other by their own names."""

import os
import sys

sys.path.append(os.path.dirname(os.path.abspath(__file__)))
