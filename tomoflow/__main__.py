import sys

from tomoflow.cli import main

sys.exit(main())
