from seqlode.plans.cli import main

main()
