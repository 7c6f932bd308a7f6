from cohortry import session


def test_configure_sets_what_the_operators_rely_on(spark):
    other = session.configure(spark.newSession())
    for key, value in session.RUNTIME_SETTINGS.items():
        assert other.conf.get(key) == value
