from quern.plans.pipeline import main

main()
