import sys

from chronolith.cli import main

sys.exit(main())
