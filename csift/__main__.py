import sys

from csift.cli import main

sys.exit(main())
