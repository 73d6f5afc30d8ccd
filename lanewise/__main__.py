import sys

from lanewise.cli import main

sys.exit(main())
