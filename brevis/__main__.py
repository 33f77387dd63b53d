from brevis.sources.text import main

raise SystemExit(main())
