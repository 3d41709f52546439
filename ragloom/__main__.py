"""python -m ragloom"""

import sys

from .cli import main

sys.exit(main())
