from strataweave.cli import main

main()
