"""Small tables for the pipeline's tests."""

import random


def base_tables(spark, folder, rows=60):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("aeiourstln", k=rng.randint(3, 8))) for _ in range(400)]
    data = []
    for i in range(rows):
        words = rng.choices(vocabulary, k=rng.randint(30, 90))
        text = " ".join(words)
        data.append((i, text, "en", f"s{i % 4}", len(text), 5))
        if i % 6 == 0:
            words[3] = "changed"
            data.append((1000 + i, " ".join(words * 1), "en", "s1", 0, 5))
        if i % 10 == 0:
            data.append((2000 + i, f"{text} password = hunter2hunter2 end", None, None, None, 5))
    if rows:
        data += [(3000, None, None, None, None, None), (3001, "", "en", "s0", 0, 1), (None, " ".join(vocabulary[:50]), "en", "s2", 1, 1), (3002, "x " * 500, "en", "s2", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, rows, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
