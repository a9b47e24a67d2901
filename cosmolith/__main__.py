from cosmolith.cli import main

print(main())
