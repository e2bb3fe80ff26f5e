"""Made-up businesses with noisy records."""

import random

A = "alpha bravo cedar delta ember falcon garnet harbor indigo jasper kestrel lumen maple nectar opal prairie quartz raven sierra tundra umber velvet willow xenon yarrow zephyr".split()
B = "foods motors labs textiles dental bakery optics marine travel books tiles steel paper glass tools paints toys farms media".split()


def businesses(spark, seed, n):
    """(raw tables by source, true pairs (e, src, r))."""
    rng = random.Random(seed)
    one, rest, truth = [], {2: [], 3: []}, []
    for i in range(n):
        name, number = f"{rng.choice(A)} {rng.choice(A)} {rng.choice(B)}", rng.randrange(1, 4000)
        street, city, country = f"{rng.choice(A)} {rng.choice(['Street', 'Road', 'Avenue'])}", rng.choice(A), ("US", "India")[i % 2]
        one.append((f"S1-{i}", f"{name} Private Limited", f"{number} {street}, {city}", country))
        for src in (2, 3):
            if rng.random() < 0.7:
                noisy = name.replace("a", "4", 1) if rng.random() < 0.2 else name.upper()
                rest[src].append((f"S{src}-{i}", f"{noisy} Pvt. Ltd.", "" if rng.random() < 0.1 else f"{number}, {street} {city}", country))
                truth.append((f"S1-{i}", src, f"S{src}-{i}"))
    ddl = "entity_id string, business_name string, business_address string, country string"
    frames = {1: spark.createDataFrame(one, ddl)} | {k: spark.createDataFrame(v, ddl) for k, v in rest.items()}
    return frames, spark.createDataFrame(truth, "e string, src int, r string")
