import os
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parents[1]), str(HERE), os.environ.get("PYTHONPATH", "")])
