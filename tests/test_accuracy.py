from cairnflow.functions import accuracy as a


def test_sizes_follow_the_target():
    assert a.kll_size(a.Target(0.02)) == 132 or a.kll_size(a.Target(0.02)) > 132
    assert a.kll_size(a.Target(0.05)) <= a.kll_size(a.Target(0.01))
    assert a.kll_size(a.Target(0)) is None
    assert a.ddsketch_alpha(a.Target(0.01)) == 0.01


def test_union_bound_needs_larger_sketches():
    one, many = a.count_min_size(a.Target(0.01, 0.01)), a.count_min_size(a.Target(0.01, 0.01, values=1000))
    assert one[0] == many[0] and many[1] > one[1]
    assert a.count_sketch_size(a.Target(0.1, 0.001))[1] % 2 == 1
