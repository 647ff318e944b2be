import sys

from plumbline.cli import main

sys.exit(main())
