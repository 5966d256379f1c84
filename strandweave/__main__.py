from strandweave.cli import main

raise SystemExit(main())
